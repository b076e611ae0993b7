"""The operators on small tables: nulls, empty and long texts, repeated rows, empty tables, further columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillveil.llm import anatomy, encode, langid, mojibake, packing, pii, readability, replies, sentences

MAIL = "Hi Gwen,\n\nThe total is fine. Thanks for the report. We meet at 8:05 sharp.\n\nBest wishes,\nNora\n\n-- \nNora Coldwick\nAccounts\nTel. 07700 900151\n\nOn 12 May 2021, Owen Fell <o@x.example> wrote:\n> We meet at noon. Bring cups.\n"
FRENCH = "Bonjour Léa,\n\nLe total est prêt. Merci pour le rapport. Venez à midi s'il vous plaît.\n\nBises,\nZoé\n"
ENGLISH_BODY = ["The total is fine.", "Thanks for the report.", "We meet at 8:05 sharp."]
FRENCH_BODY = ["Le total est prêt.", "Merci pour le rapport.", "Venez à midi s'il vous plaît."]


def turned(mail, body, k):
    """The same mail with its sentences in another order, so that each of them ends a line in some mail."""
    return mail.replace(" ".join(body), " ".join(random.Random(k).sample(body, len(body)) if k else body))


SCHEMA = "row_id bigint, message string, subject string, language string, sender string, flag string"


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for k in range(60):
        french = turned(FRENCH, FRENCH_BODY, k)
        mixed = french.replace("\n\nBises", "\n" + " ".join(random.Random(k + 7).sample(ENGLISH_BODY, 2)) + "\n\nBises")
        rows += [(3 * k, turned(MAIL, ENGLISH_BODY, k), "Café plans", "en", "a", None), (3 * k + 1, french.replace("\n", "\r\n"), "Déjà prêt ?", "fr" if k % 2 else "xx", "a", None), (3 * k + 2, mixed, None, "fr", None, "x")]
    rows += [(900, None, None, None, None, None), (901, "", "", "", "", ""), (902, " \n\n\t", " ", "fr", None, None), (903, "!!!", "?", None, None, None), (904, "".join(turned(MAIL, ENGLISH_BODY, k) for k in range(60)), "x", "en", "a", None), (905, "CafÃ© prÃªt", "DÃ©jÃ  prÃªt ?".replace("  ", "\xa0 "), "fr", "a", None), (906, "a�b", None, "fr", "a", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, []).append(tuple(r[c] for c in cols))
    return out


def test_lines(samples, none):
    found = by_row(replies.p6_found(samples), "line_no")
    assert sorted(x for (x,) in found[0]) == [7, 8, 9, 10, 12, 13] and not {900, 901, 902, 903} & found.keys() and 1 not in found
    texts = {r.row_id: r.new_text for r in replies.p6_new_text(samples).collect()}
    assert texts[0].endswith("Best wishes,\nNora") and texts[900] is None and texts[901] == "" and len(texts) == samples.count()
    assert replies.p6_found(none).count() == 0


def test_sentences(samples, none):
    found = by_row(sentences.p3_found(samples), "start_char", "end_char")
    units = [MAIL[a:b] for a, b in sorted(found[0])]
    assert units[:4] == ["Hi Gwen,", "The total is fine.", "Thanks for the report.", "We meet at 8:05 sharp."]
    assert not {900, 901, 902, 903} & found.keys() and len(found[904]) >= 60 * len(units) - 60
    assert sentences.p3_found(none).count() == 0
    # Staged units are those of the direct path.
    lines = replies.fitted(samples)
    staged = sentences.stage_messages(samples, lines)
    events = sentences.fit_events(sentences.count_events(staged))
    direct = [(a, b) for a, b, _, _ in sentences.message_units([MAIL], sentences.Lines([MAIL], lines), events)[0]]
    assert sorted(by_row(sentences.sentence_units(staged, events), "start_char", "end_char")[0]) == direct


def test_languages(spark, samples, none):
    seeds = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("The total is fine. Thanks for the report and the cups.", "en"), ("We meet at noon, bring cups.", "en"), ("Le total est prêt. Merci pour le rapport et les verres.", "fr"), ("Venez à midi, apportez des verres.", "fr"), ("Das ist für die Gäste und den Bericht.", "de"), ("El total está listo, gracias por el informe.", "es")] * 3)], "sample_id int, text string, lang string")
    found = by_row(langid.p5_found(samples, seeds), "scope", "start_char", "lang")
    assert 0 not in found and ("message", 0, "fr") in found[1] and [x for x in found[2] if x[0] == "segment"][0] == ("segment", 0, "fr")
    assert {x[2] for x in found[2]} == {"fr", "en"} and not {900, 901, 902, 903} & found.keys()
    assert langid.p5_found(none, seeds).count() == 0
    nothing = samples.filter("row_id in (900, 901, 902, 903)")
    assert langid.p5_found(nothing, seeds).count() == langid.p5_languages(nothing, seeds).count() == sentences.p3_found(nothing).count() == 0
    assert langid.p5_found(samples, seeds.limit(0)).count() >= 0
    bare = spark.createDataFrame([(1, "64510", None, "de", "a", None), (2, "https://x.example/1", None, "xx", "a", None), (3, "+1 212 555 0179\na@b.example", None, None, "a", None)], SCHEMA)
    assert not {1, 2, 3} & by_row(langid.p5_found(samples.unionByName(bare.withColumn("row_id", F.col("row_id") + 5000)).withColumn("row_id", F.when(F.col("row_id") > 5000, F.col("row_id") - 5000).otherwise(F.col("row_id") + 10_000)), seeds), "scope").keys()
    sure = langid.p5_languages(samples, seeds).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 < sure[0] <= sure[1] <= 1


def test_languages_learn_from_every_message(spark):
    """Words that only three of 900 messages hold are learned, whichever these are."""
    seeds = spark.createDataFrame([(1, "O total está pronto e não temos mais copos para a reunião.", "pt"), (2, "O total está listo e non temos máis vasos para a xuntanza.", "gl"), (3, "The total is fine and we have no more cups for the meeting.", "en")], "sample_id int, text string, lang string")
    last = [r.id for r in spark.range(900).orderBy(F.shiftrightunsigned(F.xxhash64("id"), 2).desc()).limit(3).collect()]
    common = {"pt": "Não temos mais copos para a reunião.", "gl": "Non temos máis vasos para a xuntanza."}
    rows = [(k, common[x] + ("\nZumbrel brestig wolnit kastrup." if k in last else ""), x, "m") for k in range(900) for x in ["gl" if k % 2 or k in last else "pt"]]
    rows += [(1000, "Zumbrel kastrup brestig wolnit.", None, "m")]
    samples = spark.createDataFrame(rows, "row_id bigint, message string, language string, sender string").repartition(3)
    assert by_row(langid.p5_found(samples, seeds), "scope", "lang")[1000] == [("message", "gl")]
    model = anatomy.fit_line_model(samples, 901)
    assert model.label_many([["Non temos máis vasos."]])[0] == ["N"]


def test_garbled(samples, none):
    found = by_row(mojibake.p4_found(samples), "field_name", "restored_md5")
    assert ("message", hashlib.md5("Café prêt".encode()).hexdigest()) in found[905] and found[906] == [("message", "lost")] and set(found) == {905, 906}
    assert mojibake.p4_found(none).count() == 0


def test_personal_information(spark, samples, none):
    gazetteer = spark.createDataFrame([("Nora", "PER", "en"), (None, "PER", "en"), ("Zoé", "PER", "fr"), ("Léa", "PER", "fr")], "word string, entity_group string, lang string")
    found = by_row(pii.p2_found(samples, gazetteer), "kind", "start_char", "end_char")
    # No list and no header names the surname Coldwick, so only the given name is found before it.
    assert sorted((k, MAIL[a:b]) for k, a, b in found[0]) == sorted([("name", "Nora"), ("name", "Nora"), ("phone", "07700 900151"), ("name", "Owen Fell"), ("email", "o@x.example")])
    assert not {900, 901, 902, 903} & found.keys()
    lexicon = pii.fit_lexicon(samples, gazetteer)
    masked = {r.row_id: r for r in pii.masked(samples.withColumn("masked", F.lit("old")), lexicon, b"key").collect()}
    assert "07700" not in masked[0].masked and masked[900].masked is None and masked[901].masked == "" and masked[2].flag == "x"
    assert pii.p2_found(none, gazetteer).count() == 0


def test_tokens(spark):
    rows = [(1, "naïve café", "x"), (1, "naïve café", "y"), (2, None, None), (3, "", None), (4, " \n", None), (5, "word " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    out = encode.encode_documents(docs).collect()
    assert len(out) == 6 and all(list(r.ids) == plain.encode(r.text or "", add_special_tokens=False).ids for r in out)
    assert {(r.doc_id, r.n) for r in encode.encode_documents(docs, out="n", lengths_only=True).collect()} == {(r.doc_id, len(r.ids)) for r in out}
    assert encode.encode_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode.encode_documents(docs, tokenizer="nothing")


def test_containers(spark):
    items = spark.createDataFrame([("s", 100, k, n) for k, n in enumerate([30, 70, 50, 50, 100, 250, 0, None, 20, 80] * 30)], "container string, capacity int, doc_id bigint, n_tokens int")
    out = packing.fill_containers(items, block_items=60)
    rows = out.collect()
    fills = {}
    for r in rows:
        fills[r.bin_id] = fills.get(r.bin_id, 0) + r.n_tokens
    total = 30 * 650
    assert max(fills.values()) <= 100 and sum(fills.values()) == total and len(fills) <= total / 100 + 3
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part, r.start_token, r.n_tokens))
    assert len(parts) == 300 and sorted(parts[5]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and parts[7] == [(0, 0, 0)]
    assert sorted(map(tuple, packing.fill_containers(items, block_items=60).collect())) == sorted(map(tuple, rows))
    assert packing.fill_containers(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(items.withColumn("capacity", F.lit(0)))


def test_reading_levels(spark):
    kinds = {"basic": "The cat is in. I ran home. We go now. ", "middle": "We spent a wonderful week with Nora in the mountains last year. You can ring me after work. ", "advanced": "Notwithstanding the reservations previously articulated by the committee, the administration intends to undertake a reconsideration of existing authorisations, which presupposes a substantial reconfiguration. "}
    rows = [(k * 3 + i, t * (5 + k % 4), "en") for k in range(40) for i, t in enumerate(kinds.values())]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "en"), (902, "word " * 50, None), (903, "mot " * 50, "it"), (904, "too short", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k * 3 + i, b if k else "basic", "r") for k in range(20) for i, b in enumerate(kinds)] + [(5, None, "r"), (None, "basic", "r")], "doc_id bigint, band string, rater string")
    out = {r.doc_id: r.band for r in readability.p9_found(docs, labels).collect()}
    assert not {900, 901, 902, 903, 904} & out.keys()
    assert all(out[k] == list(kinds)[k % 3] for k in out) and len(out) >= 100
    assert readability.p9_found(docs.limit(0), labels).count() == 0
    assert readability.p9_found(docs, labels.limit(0)).filter("band is not null").count() == 0
