import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.config import Settings
from quillveil.operators import entities as E
from quillveil.operators import metrics as M
from quillveil.operators import review as R
from quillveil.plans.pipeline import pseudonymize

# Pools, names and whole records with their pseudonymized texts.
POOLS = {"es": ["José", "Angel", "Alex"], "fr": ["Claude", "Dominique", "Camille"], "de": ["Mika"]}
NAMES = [("Alice", "PER"), ("Angel", "PER"), ("Tony", "PER"), ("MeetingPoint", "LOC"), ("Tour de France", "MISC"), ("Microsoft", "ORG"), ("Claude", "PER")]


@pytest.fixture(scope="module")
def ner(spark):
    return E.gazetteer_backend(spark, spark.createDataFrame(NAMES, "word string, entity_group string"))


def run(spark, ner, rows, **options):
    df = spark.createDataFrame(rows, "row_id bigint, subject string, content string").repartition(3)
    settings = Settings(**({"pseudo_first_names": POOLS, "default_lang": "es"} | options))
    return {r.row_id: r for r in pseudonymize(df, settings, "row_id", ner).collect()}


def test_whole_records(spark, ner):
    rows = [
        (1, None, "Alice (alice@gmail.com) viendra au bâtiment à 10h00. Nous nous rendrons ensuite au MeetingPoint"),
        (2, "unmatched", "Esta foto fue tomada por Alice el 28.03.2025 a las 10:30. Compruébelo en el archivo adjunto"),
    ]
    out = run(spark, ner, rows, default_lang="fr")
    assert out[1].pseudo_content == "Claude ([email]) viendra au bâtiment à [number]h[number]. Nous nous rendrons ensuite au [location]"
    assert out[2].pseudo_content == "Esta foto fue tomada por Claude el 28.03.2025 a las 10:30. Compruébelo en el archivo adjunto"
    assert out[2].detected_datetime == {"content": ["28.03.2025 a las 10:30"]} and out[1].pseudo_subject is None and "subject" not in out[1].lang
    assert out[1].ne_sent == {"content": [0, 1]} and out[1].sentences_after_email["content"][0].startswith("Alice ([email])")


def test_toggles(spark, ner):
    rows = [(1, "", "Alice a@b.de 12")]
    assert run(spark, ner, rows, pseudo_ne=False)[1].pseudo_content == "Alice [email] [number]"
    off = run(spark, ner, rows, pseudo_emailaddresses=False, pseudo_numbers=False)[1]
    assert off.pseudo_content == "José a@b.de 12" and off.sentences_after_email == {}
    assert run(spark, ner, [(1, None, None)])[1].pseudo_content is None


def test_names_stay_linked_across_fields(spark, ner):
    out = run(spark, ner, [(1, "foto por Tony e Alice", "por Alice e Tony e Alice")], pseudo_first_names={"es": ["José", "Ana", "Alex"]})
    assert out[1].pseudo_subject == "foto por José e Ana" and out[1].pseudo_content == "por Ana e José e Ana"


def test_pool_shrinks_from_the_record_on(spark, ner):
    rows = [(1, "", "Tony"), (2, "", "Angel e Tony"), (3, "", "Tony e Alice")]
    out = run(spark, ner, rows, pseudo_first_names={"es": ["Angel", "Ana", "Alex"]})
    assert [out[k].pseudo_content for k in (1, 2, 3)] == ["Angel", "Ana e Alex", "Ana e Alex"]
    with pytest.raises(Exception, match="used up"):
        run(spark, ner, [(1, "", "Alice")], pseudo_first_names={"es": ["Alice"]})
    with pytest.raises(ValueError):
        run(spark, ner, rows, pseudo_first_names={})


def ents(*rows):
    return F.array(*[F.struct(F.lit(w).alias("word"), F.lit(g).alias("entity_group"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("pseudonym"), F.lit(0).alias("sent_idx")) for w, g, a, b, p in rows])


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_folds(spark):
    assert value(spark, E.replace_entities(F.lit("Le Tour de France est"), ents(("Tour de France", "MISC", 3, 17, "[misc]")))) == "Le [misc] est"
    pool = F.array(*map(F.lit, ["A", "B", "C", "D"]))
    people = ents(*[(w, "PER", 0, 0, "") for w in ("Jean", "jean", "JEAN", "Luc", "Eve")])
    assert [c.p for c in value(spark, E.choose_pseudonyms(people, pool))] == ["A", "A", "A", "D", "A"]  # repeats count; the pool ends
    mixed = ents(("Rom", "LOC", 0, 0, ""), ("Rom", "PER", 0, 0, ""), ("X", "NEW", 0, 0, ""))
    assert [c.p for c in value(spark, E.choose_pseudonyms(mixed, pool))] == ["[location]", "[location]", "[misc]"]


def test_highlight(spark):
    text = "Hello, my name is John Doe. You can call me John Doe."
    people = ents(("John Doe", "PERSON", 18, 26, ""), ("John Doe", "PERSON", 44, 52, ""))
    span = '<span style="background-color:{}">John Doe</span>'
    assert value(spark, R.highlight(F.lit(text), people, {"PERSON": "lightblue"})) == text.replace("John Doe", span.format("lightblue"))
    assert value(spark, R.highlight(F.lit(text), people)) == text.replace("John Doe", span.format("lightgray"))
    assert value(spark, R.nth_occurrence(F.lit(text), F.lit("John Doe"), 2)) == 44
    with pytest.raises(Exception, match="lacks"):
        value(spark, R.highlight(F.lit(text), ents((None, "PER", 0, 1, ""))))
    assert value(spark, R.repseudonymize(F.array(F.lit("Bo met Al")), ents(("Bo", "PER", 0, 2, ""), ("Al", "PER", 7, 9, "")), F.array(F.lit("X"), F.lit("Y")))) == ["X met Y"]


def test_corrections(spark):
    schema = "record_id int, field_name string, sent_idx int, ent_idx int, entity_group string, word string, start_char int, end_char int"
    found = spark.createDataFrame([(1, "c", 0, 0, "PER", "Bo", 0, 2), (1, "c", 0, 1, "LOC", "Al", 7, 9), (1, "c", 0, 2, "ORG", "X", 9, 10)], schema)
    edits = spark.createDataFrame([(1, "c", 0, 0, "remove", None, None, None, None), (1, "c", 0, 1, "regroup", "PER", None, None, None), (1, "c", 0, 2, "reword", None, "Xy", None, None), (1, "c", 1, 0, "insert", "LOC", "Rom", 3, 6)],
                                  "record_id int, field_name string, sent_idx int, ent_idx int, action string, entity_group string, word string, start_char int, end_char int")
    keys = ["record_id", "field_name", "sent_idx", "ent_idx"]
    words = spark.createDataFrame([(1, "c", 0, k, "PER", w, 5, 5 + len(w)) for k, w in enumerate(["Mr Smith", "Smith", "Bob", "Ann B", "Lee"])], schema)
    new = spark.createDataFrame([(1, "c", 0, k, "reword", None, w, None, None) for k, w in enumerate(["Smith", "Mr Smith", "Al", "Ann"])], edits.schema)
    assert sorted(tuple(r)[5:] for r in R.apply_corrections(words, new, keys).select(words.columns).collect()) == [("Al", 5, 7), ("Ann", 5, 8), ("Lee", 5, 8), ("Mr Smith", 2, 10), ("Smith", 8, 13)]
    given = found.withColumn("pseudonym", F.lit("[location]"))
    regroup = edits.filter("action = 'regroup'").withColumn("pseudonym", F.lit("Zoé"))
    assert {(r.word, r.entity_group, r.pseudonym) for r in R.apply_corrections(given, regroup, keys).collect()} == {("Al", "PER", "Zoé"), ("Bo", "PER", "[location]"), ("X", "ORG", "[location]")}
    assert sorted(tuple(r)[2:] for r in R.apply_corrections(found, edits, keys).select(found.columns).collect()) == [(0, 1, "PER", "Al", 7, 9), (0, 2, "ORG", "Xy", 9, 11), (1, 0, "LOC", "Rom", 3, 6)]


def test_metrics(spark):
    rows = spark.createDataFrame([("[e] [e]", "[e]"), ("a", "[e]"), ("[e]", "[e]")], "a string, b string").select(M.mask_counts("a", "b", "[e]").alias("c")).select("c.*")
    s = M.scores(rows).first()
    assert (s.tp, s.fp, s.fn, s.precision) == (2, 1, 1, 2 / 3) and s.exact == 1 / 3
    assert M.scores(rows.limit(0)).first().precision == 0.0
    assert tuple(value(spark, M.set_counts(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))))) == (1, 1, 1)
    assert [tuple(x) for x in value(spark, M.bio_spans(F.array(*map(F.lit, ["B-PER", "I-PER", "O", "I-LOC", "B-LOC"]))))] == [("PER", 0, 1), ("LOC", 3, 3), ("LOC", 4, 4)]
    assert [tuple(x) for x in value(spark, M.token_offsets(F.lit("a bb a"), F.array(*map(F.lit, ["a", "bb", "a", "z"]))))] == [("a", 0, 1), ("bb", 2, 4), ("a", 5, 6), ("z", -1, -1)]
    parsed = value(spark, M.parse_iob_line(F.lit("BOS fly to rome EOS\tO O O B-city flight")))
    assert parsed.tokens == ["fly", "to", "rome"] and parsed.tags == ["O", "O", "B-city"]
    two = spark.createDataFrame([(1,), (1,)], "k int")
    assert M.validated_join(two.distinct(), two.distinct().withColumn("v", F.lit("x")), ["k"]).collect() == [(1, "x")]
    with pytest.raises(Exception, match="isn't unique"):
        M.validated_join(two, two.distinct(), ["k"]).collect()


def test_one_partition_or_many(spark, ner):
    rows = [(k, "", f"Alice y Tony y Angel {k}") for k in range(40)]
    df = spark.createDataFrame(rows, T._parse_datatype_string("row_id bigint, subject string, content string"))
    pools = {"es": ["Angel", "Ana", "Eva", "Lia", "Noa"]}
    texts = [sorted(map(tuple, pseudonymize(x, Settings(pseudo_first_names=pools, default_lang="es"), "row_id", ner).select("row_id", "pseudo_content").collect())) for x in (df.coalesce(1), df.repartition(4))]
    assert texts[0] == texts[1]


def test_entries_of_several_words(spark, tmp_path):
    from quillveil.plans.queries import gazetteer_spans

    spark.createDataFrame([(1, "Anna von São João da Pesqueira, São João."), (2, "मीरा और मीराबाई"), (3, None)], "record_id bigint, content string").write.parquet(f"{tmp_path}/email_records.parquet")
    spark.createDataFrame([("São João", "LOC"), ("São João da Pesqueira", "LOC"), ("Anna", "PER"), ("मीर", "PER"), ("मीरा", "PER")], "word string, entity_group string").write.parquet(f"{tmp_path}/gazetteer.parquet")
    found = sorted(tuple(r) for r in gazetteer_spans(spark, str(tmp_path)).collect())
    assert found == [(1, 0, 4, "Anna", "PER"), (1, 9, 30, "São João da Pesqueira", "LOC"), (1, 32, 40, "São João", "LOC"), (2, 0, 4, "मीरा", "PER")]


def test_all_entities_of_all_records_highlighted(spark, tmp_path):
    from quillveil.plans.queries import highlight_records

    spark.createDataFrame([(1, "Mail a@b.de to F. H. Bo. Al of Rom, says Al."), (2, "<p>Nobody. Here</p>"), (3, "Bo")], "record_id bigint, content string").write.parquet(f"{tmp_path}/email_records.parquet")
    ents = [(1, 0, 0, "PER", "F. H. Bo", 16), (1, 1, 0, "PER", "Al", 0), (1, 1, 1, "LOC", "Rom", 6), (1, 1, 2, "PER", "Al", 16), (3, 0, 0, "PER", "Al", 0)]
    spark.createDataFrame(ents + ents[:1], "record_id bigint, sent_idx int, ent_idx int, entity_group string, word string, start_char int").write.parquet(f"{tmp_path}/entity_list.parquet")
    mark = lambda w, c="lightblue": f'<span style="background-color:{c}">{w}</span>'
    rows = {r.record_id: (r.html, r.unplaced) for r in highlight_records(spark, str(tmp_path)).collect()}
    assert rows == {1: (f"Mail [email] to {mark('F. H. Bo')}.<br>{mark('Al')} of {mark('Rom', 'lightgreen')}, says {mark('Al')}.", 0), 2: ("Nobody.<br>Here", 0), 3: ("Bo", 1)}


def test_used_up_pools_have_a_stand_in(spark, ner):
    df = spark.createDataFrame([(1, "", "the meeting with Alice and Tony is for you"), (2, "", "le livre de Alice est dans la maison pour vous")], "row_id bigint, subject string, content string")
    settings = Settings(default_lang="", pseudo_first_names={"en": ["Alice"], "fr": ["Camille"]})
    out = {r.row_id: r.pseudo_content for r in pseudonymize(df, settings, "row_id", ner, languages="stopwords", used_up="Inconnu").collect()}
    assert out == {1: "the meeting with Inconnu and Inconnu is for you", 2: "le livre de Camille est dans la maison pour vous"}


def test_models_named_by_the_settings(spark):
    from quillveil import backends
    from quillveil.functions import lang as L

    def fake_detector(languages=(), **_):
        ranked = [("xx", 0.6), ("yy", 0.3), ("zz", 0.1)]
        return lambda text: [r for r in reversed(ranked) if not languages or r[0] in languages]

    def fake_recogniser(task, model):
        return lambda text: [{"entity_group": "PER", "word": model, "start": text.index(model), "end": text.index(model) + len(model), "score": 0.5}] if model in text else []

    def fake_splitter(model="default", lang="de"):
        return lambda text: text.split(model)

    df = spark.createDataFrame([(1, "", "Tony a bc|Tony d"), (2, "12", "7")], "row_id bigint, subject string, content string")
    kept = dict(backends._FACTORIES)
    try:
        backends.register("langid", fake_detector), backends.register("transformers", fake_recogniser), backends.register("spacy", fake_splitter)
        ranked = df.select(L.ranked_languages("content", "langid").alias("x"), L.ranked_languages("content", "langid", ["zz", "yy"]).alias("y")).collect()
        assert [r.lang for r in ranked[0].x] == ["xx", "yy", "zz"] and [r.lang for r in ranked[0].y] == ["yy", "zz"] and ranked[1].x == []
        settings = Settings(default_lang="", pseudo_first_names=POOLS, lang_detection_lib="langid", spacy_model="|", ner_pipeline={"task": "token-classification", "model": "Tony"})
        out = {r.row_id: r for r in pseudonymize(df, settings, "row_id").collect()}
        assert out[1].lang == {"content": "xx"} and out[1].sentences == {"content": ["Tony a bc", "Tony d"]} and out[1].pseudo_content == "José a bc José d" and out[2].lang == {"subject": None, "content": None}
    finally:
        backends._FACTORIES.clear(), backends._FACTORIES.update(kept)
    with pytest.raises(ValueError):
        L.detect_language("content", "nothing")
    with pytest.raises(Exception, match="isn't installed"):
        df.select(L.detect_language("content", "langdetect")).collect()


@pytest.mark.parametrize("range_rows", [3, 7, 1000])
def test_runs_over_ranges(spark, range_rows):
    import random

    from quillveil.functions.lang import language_runs

    rng, rows, expected = random.Random(range_rows), [], []
    for key in ("a", "b", None):
        at, last = 0, object()
        for _ in range(40 if key == "a" else 9):
            at += rng.choice([1, 1, 5])
            lang = rng.choice(["x", "x", "x", None, "y"])
            rows.append((key, at, lang))
            if lang == last and expected:
                expected[-1] = (*expected[-1][:2], at + 1, lang)
            else:
                expected.append((key, at, at + 1, lang))
            last = lang
    df = spark.createDataFrame(rows, "k string, i bigint, l string").repartition(3)
    found = [tuple(r) for r in language_runs(df, "k", "i", "l", range_rows).select("k", "begin", "end", "lang").collect()]
    order = lambda r: (str(r[0]), r[1])
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert language_runs(df.limit(0), "k", "i", "l", range_rows).count() == 0


def test_references_and_tokens(spark):
    import html

    from quillveil.functions import text as X

    texts = ["<b>&eacute;&#233;&#xE9;&hellip;&amp;lt;</b>", "<i>a &b; &unknown; &#0; &#xD800; &amp</i>", "no tag &amp;", "<p>&notin;&CounterClockwiseContourIntegral;&#128512;</p>", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = [r.x for r in df.select(X.html_to_text("t").alias("x")).collect()]
    assert found == [html.unescape("&eacute;&#233;&#xE9;&hellip;&amp;lt;"), "a &b; &unknown; &#0; &#xD800; &amp", "no tag &amp;", html.unescape("&notin;&CounterClockwiseContourIntegral;&#128512;"), None, ""]
    joined = ["l ' eau est ( ici ) , oui !", "“ on y va ”  dit 5 %", " a ’ b "]
    df = spark.createDataFrame([(t,) for t in joined], "t string").coalesce(1)
    assert [r.x for r in df.select(X.detokenize("t").alias("x")).collect()] == ["l'eau est (ici), oui!", "“on y va” dit 5%", "a’b"]
