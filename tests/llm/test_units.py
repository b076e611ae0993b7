"""Small cases without a session: encoders, packings, pseudonyms, segments, readings."""

import random
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import anatomy as A
from quillveil.llm import encode as C
from quillveil.llm import langid as L
from quillveil.llm import mojibake as G
from quillveil.llm import packing as K
from quillveil.llm import pii as P
from quillveil.llm import readability as R
from quillveil.llm import replies as T
from quillveil.llm import sentences as S


@pytest.fixture(scope="module")
def encoder():
    with open(f"{C.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        return C.ForcedBoundaryEncoder(C.read_ranks(f.read()))


@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ09 '\"\n\t\r\xa0　。é日本语ไхсtrelvdm<|>👍́²½-—_\x00\x85«”s")), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_fragments_equal_the_whole(encoder, texts):
    flat, ends = encoder.encode_batch(pa.array(texts, pa.string()))
    assert [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [encoder.encoding.encode_ordinary(t) for t in texts]


def test_encoder_edges(encoder):
    assert encoder.encode(None) == [] and encoder.encode("") == []
    long = "mail " * 30_000 + "x" * 20_000
    assert encoder.encode(long) == encoder.encoding.encode_ordinary(long)
    assert encoder.encoding.decode(encoder.encode("<|endoftext|> naïve 日本")) == "<|endoftext|> naïve 日本"
    sliced = pa.array(["a", "bb", "ccc"]).slice(1)
    flat, ends = encoder.encode_batch(sliced)
    assert encoder.encoding.decode(flat) == "bbccc" and len(ends) == 3


def test_packing_is_valid_and_close_to_the_bound():
    rng = random.Random(3)
    sizes = [rng.choice([0, rng.randrange(1, 60), rng.randrange(60, 400)]) for _ in range(400)]
    best = K.evolve(sizes, 512, 1, [])[0]
    assert sorted(i for b in best.bins for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) == f <= 512 for b, f in zip(best.bins, best.fills, strict=True))
    assert len(best.bins) <= -(-sum(sizes) // 512) + 1
    assert K.from_codes(best.codes(400), sizes).fitness(512) == pytest.approx(best.fitness(512))
    child = K.crossover(best, K.evolve(sizes, 512, 2, [])[0], sizes, 512, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(400)) and max(child.fills) <= 512


def test_crossover_beats_best_fit():
    # Triples that fill a bin exactly; best fit in falling order pairs the wrong ones.
    rng, capacity, better = random.Random(1), 1000, 0
    for seed in range(6):
        sizes = []
        for _ in range(40):
            a, b = rng.randrange(260, 480), rng.randrange(200, 330)
            sizes += [a, b, capacity - a - b]
        greedy = K.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity, [], [])
        start = K.evolve(sizes, capacity, seed, [], generations=0, population=8)[0]
        grown = K.evolve(sizes, capacity, seed, [], generations=150, population=8)[0]
        assert len(grown.bins) <= len(start.bins) <= len(greedy.bins)
        # Elites that migrate from another island are taken up.
        moved = K.evolve(sizes, capacity, seed + 50, [grown.codes(len(sizes))], generations=2, population=8)[0]
        assert moved.fitness(capacity) >= grown.fitness(capacity)
        better += grown.fitness(capacity) > start.fitness(capacity) and len(grown.bins) < len(greedy.bins)
    assert better >= 3


KEY = b"a key of the tests"


@pytest.mark.parametrize("kind", ["identity", "phone"])
@given(st.from_regex(r"[+(]?[0-9]{1,4}[ )\-][0-9]{3,6}[\-. ][0-9A-Za-z]{2,5}", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_pseudonyms_keep_the_format_and_go_back(kind, text):
    made = P.pseudonym_number(text, KEY, kind=kind)
    assert [("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c) for c in made] == [("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c) for c in text]
    assert P.pseudonym_number(made, KEY, back=True, kind=kind) == text and P.pseudonym_number(text, KEY, kind=kind) == made


def test_pseudonyms_are_a_permutation():
    assert len({P.pseudonym_number(f"{n:04d}", KEY) for n in range(10_000)}) == 10_000
    days = [date(2000, 1, 1), date(1900, 1, 1), date(2099, 12, 31), date(2024, 2, 29)]
    assert [P.pseudonym_date(P.pseudonym_date(d, KEY), KEY, back=True) for d in days] == days
    assert P.pseudonym_date(date(1850, 1, 1), KEY) == date(1850, 1, 1)
    assert P.pseudonym_number("553 292 287", b"a") != P.pseudonym_number("553 292 287", b"b")


def digits(text):
    return "".join(c for c in text if c.isdigit())


def test_one_telephone_number_is_linked_however_it_is_written():
    made = [P.pseudonym_number(t, KEY, kind="phone") for t in ("+33 6 12 34 56 78", "06 12 34 56 78", "0033 6.12.34.56.78", "+33 (0)6 12345678")]
    assert {digits(m)[-9:] for m in made} == {digits(made[0])[-9:]} and digits(made[0])[-9:] != "612345678"
    assert made[0].startswith("+33 ") and made[1].startswith("0") and made[2].startswith("0033 ") and made[3].startswith("+33 (0)")
    other = P.pseudonym_number("06 12 34 56 79", KEY, kind="phone")
    assert digits(other)[-9:] != digits(made[1])[-9:]


@pytest.mark.parametrize("text", ["030.660.872-39", "41222553-K", "64400547 H", "1 80 04 92 180 628 95", "281 417 725", "X5170490V"])
def test_check_digits_stay_right(text):
    compact = "".join(c for c in text if c.isalnum())
    assert (P.checked(compact) is None) == (text == "X5170490V") and P.told_alone(text) == (text != "X5170490V")
    made = P.pseudonym_number(text, KEY)
    assert made != text and (P.checked("".join(c for c in made if c.isalnum())) or "")[:1] == (P.checked(compact) or "")[:1]
    assert P.pseudonym_number(made, KEY, back=True) == text
    plain = P.pseudonym_number(compact, KEY)
    assert plain == "".join(c for c in made if c.isalnum())  # separators don't part equal values


def test_numbers_need_check_digits_or_a_label():
    lexicon = P.Lexicon(set(), set())
    found = lambda t: [(k, t[a:b]) for k, a, b in P.find_mentions(t, lexicon)]
    assert found("ref. 030.660.872-39") == [("identity", "030.660.872-39")]
    assert found("ref. 030.660.872-38") == [] and found("o meu CPF 030.660.872-38") == [("identity", "030.660.872-38")]
    assert found("ring 555.123.4567 or 555-123-4567") == [("phone", "555.123.4567"), ("phone", "555-123-4567")]
    assert found("at 12 Elm Grove Street, Upper Falls, NY 12345 today") == [("address", "12 Elm Grove Street, Upper Falls, NY 12345")]


def test_dates_are_permuted_on_demand():
    text = "on 2024-02-29, 05.03.2021, 31/12/1999, 99.99.2020, v1.02.2021 and 10.0.3.17"
    made = P.mask(text, P.Lexicon(set(), set()), KEY, dates=True)
    day = P.pseudonym_date(date(2024, 2, 29), KEY)
    assert made.startswith(f"on {day:%Y-%m-%d}, {P.pseudonym_date(date(2021, 3, 5), KEY):%d.%m.%Y}, {P.pseudonym_date(date(1999, 12, 31), KEY):%d/%m/%Y}, 99.99.2020, v1.02.2021")
    assert P.mask(text, P.Lexicon(set(), set()), KEY) == text


def test_long_lines_keep_their_names():
    line = "word " * 60 + "word, Anna Maria Perlander <" + "a" * 100 + "@x.example>"
    assert P.persons(line) == ["Anna Maria Perlander"]
    assert [line[a:b] for k, a, b in P.find_mentions(line, P.Lexicon(set(), set())) if k == "name"] == ["Anna Maria Perlander"]


LEX = P.Lexicon({"nora", "coldwick", "agnès", "thorncombe", "may", "o'farrow"}, {"健太", "月島野"})


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Write to Nora Coldwick (nora.c@x.example) or ring +44 7700 900 101.", [("name", "Nora Coldwick"), ("email", "nora.c@x.example"), ("phone", "+44 7700 900 101")]),
        ("at a [at] b(dot)example, or c @ d.test", [("email", "a [at] b(dot)example"), ("email", "c @ d.test")]),
        ("d'Agnès, Mr. Unknown's and M. P. O'Farrow", [("name", "Agnès"), ("name", "Unknown"), ("name", "M. P. O'Farrow")]),
        ("le passeport n° 59CD73062 et mon NIF 224 793 616, tel. 224 793 617", [("identity", "59CD73062"), ("identity", "224 793 616"), ("phone", "224 793 617")]),
        ("Flat 2, 103 Juniper Close, Upper Pelham, HZ3 8JV", [("address", "Flat 2, 103 Juniper Close, Upper Pelham, HZ3 8JV")]),
        ("chez nous, 19, rue des Glycines, 16814 Saint-auvray, vers 8h", [("address", "19, rue des Glycines, 16814 Saint-auvray")]),
        ("on 4 May 2021, order 8840 2291 13454, v2.0.1, 10.0.3.17, @bluefinch", []),
        ("電話は07700 900193まで。月島野健太さん", [("phone", "07700 900193"), ("name", "月島野健太")]),
        ("", []),
    ],
)
def test_mentions(text, found):
    assert [(k, text[a:b]) for k, a, b in P.find_mentions(text, LEX)] == found


def test_masking():
    out = P.mask("Nora: +44 7700 900 101. NORA: +44 7700 900 101!", LEX, KEY)
    assert "7700" not in out and out.count("[phone +") == 2 and len(set(__import__("re").findall(r"\[name \w+\]", out))) == 1
    assert P.mask(None, LEX, KEY) is None and P.mask("", LEX, KEY) == ""


@pytest.mark.parametrize(("name", "word"), [("यवनिका बेलगिरी", "बेलगिरी"), ("สมหญิง ภูผาทอง", "ภูผาทอง")])
def test_own_names_with_vowel_signs(name, word):
    text = f"{word}\n{name} <a@b.example>\n"
    assert P.persons(text) == [name]
    assert [text[a:b] for k, a, b in P.find_mentions(text, P.Lexicon(set(), set())) if k == "name"] == [word, name]


def test_codes_and_limits(spark, monkeypatch):
    assert len({P.placeholder("name", f"Name {k}", KEY) for k in range(40_000)}) == 40_000
    monkeypatch.setattr(P, "LISTED", 1)
    with pytest.raises(ValueError, match="more than 1"):
        P.fit_lexicon(None, spark.createDataFrame([("A", "PER"), ("B", "PER")], "word string, entity_group string"))


def test_segments_match_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        score = [rng.uniform(-1, 1) for _ in range(30)]
        best = max(sum(score[a:b]) for a in range(30) for b in range(a + 1, 31))
        found = G.segments(list(range(30)), score, 0.0)
        assert max(sum(score[a:b]) for a, b in found) == pytest.approx(best)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))


CLEAN = ["Déjà prêt pour la réunion ? Été, élève, à bientôt, où ça", "Não percebi bem a questão sobre a inscrição", "Größe für die Gästeliste über", "¿Cuándo vienes, señor Núñez? Mañana", "Вопрос о встрече в субботу"] * 40


def scores_of(texts):
    codes = G._codes(texts)
    x, y = codes[:-1], codes[1:]
    wide = (x > 127) | (y > 127)
    keys, n = np.unique((x[wide].astype(np.int64) << 21) | y[wide], return_counts=True)
    single = dict(zip(*(a.tolist() for a in np.unique(codes, return_counts=True)), strict=True))
    total = len(codes)
    p = n / total
    part = p * np.log(np.maximum(p / (np.array([single[k] for k in (keys >> 21).tolist()]) / total * np.array([single[k] for k in (keys & 0x1FFFFF).tolist()]) / total), 1.05))
    return G.PairScores(keys, np.clip(G.PROBABLE - np.log10(part), 0, G.FLOOR), G.FLOOR)


@pytest.mark.parametrize(("shown", "was"), [("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp437", "cp1252"), ("cp1251", "cp1252")])
def test_garbled_text_comes_back(shown, was):
    scores = scores_of(CLEAN)
    for text in CLEAN[:3]:
        garbled = text.encode(was).decode(shown)
        assert G.examine(garbled, scores) == text
        assert G.examine(text, scores) is None
    twice = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert G.examine(twice, scores) == CLEAN[0]
    assert G.examine("caf�", scores) == G.LOST and G.examine("plain", scores) is None


@pytest.mark.parametrize(("shown", "was"), [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "cp1252"), ("koi8_r", "cp1251")])
def test_a_third_of_the_rows_garbled_alike(spark, shown, was):
    rng, made = random.Random(3), []
    words = [w for t in CLEAN[:5] for w in t.split()]
    for _ in range(3000):
        made.append(" ".join(rng.choices([w for w in words if (w > "\u0400") == (was == "cp1251")], k=12)))
    chars = {c: b for b, c in enumerate(G.page(was)[1])} if was != "utf-8" else {}
    read = lambda t: "".join(G.page(shown)[1][b] for b in (bytes(chars[c] for c in t) if chars else t.encode()))
    rows = [(k, read(t) if k % 3 == 0 else t) for k, t in enumerate(made)]
    wrong = {k for k, t in rows if t != made[k]}
    assert len(wrong) > 900
    found = {r.row_id: r.restored for r in G.restore_fields(spark.createDataFrame(rows, "row_id bigint, message string"), ["message"]).collect()}
    assert found.keys() == wrong and all(found[k] == made[k] for k in wrong)


def test_logical_lines_and_quotes():
    text = "a \nb\r\n> q \n> r\n\n-- \nx"
    assert [n for _, _, n in A.logical_lines(text)] == [[0, 1], [2, 3], [4], [5], [6]]
    assert A.logical_lines("") == [(0, 0, [0])] == A.line_view("")[0]
    for plain in ("a\r\n\nb\r\r\n> c\n", "\n", "x"):
        assert A.line_view(plain)[0] == A.logical_lines(plain) and A.line_view(plain)[1] == [plain[a:b].strip() for a, b, _ in A.logical_lines(plain)]


MAILS = [
    "Hi Gwen,\n\nThe total is fine. Thanks for the report.\n\nBest wishes,\nNora\n\n-- \nNora Coldwick\nAccounts\nTel. 07700 900151\n\nOn 12 May 2021, Owen Fell <o@x.example> wrote:\n> We meet at noon.\n> Bring cups.",
    "Bonjour,\nTout est prêt. Venez vite.\nBises,\nLéa\nEnvoyé de mon téléphone\n\n-----Message d'origine-----\nDe : Luc Val <l@x.example>\nEnvoyé : 5 mai 2021 8:00\nÀ : Léa\nObjet : Prêt\n\nEst-ce prêt ?",
] * 30


def test_lines_are_labelled():
    model = A.train_line_model(MAILS)
    views = [A.line_view(m)[1] for m in MAILS[:2]]
    labels, flags = model.label_many([*views, [""], ["", "!!!"]])
    assert labels[0][:7] == "G-N-CM-" and set(labels[0][7:11]) == {"S"} and labels[0][12:] == "AQQ"
    assert labels[1][0] == "G" and labels[1][1] == "N" and labels[1][4] == "S" and not set(labels[1][6:]) & A.NEW and labels[2] == "-"
    assert flags[0][0] & A.GREET and flags[0][1] == 0 and len(flags[3]) == 2


def test_places_and_units():
    found = S.places("M. A. Val paid 3.50 here. She asked, “Is it? Yes.” and left! Bye")
    assert [x[2] for x in found] == ["M.", "A.", "here.", "Yes.”", "left!"]
    assert [x[0] for x in S.places("行きます。そう？はい")] == [5, 8]
    assert [x[2] for x in S.places("ดีครับ ไปค่ะ")] == ["ดีครับ"]
    texts = ["The one is here. The two is there :-)", "... So is A. There is B!", "So is A. There is B! ..."]
    lines = S.Lines(texts, A.train_line_model([]))
    assert lines.labels == ["N"] * 3 and lines.per == [1, 2, 2]
    post = np.full(sum(lines.per), 0.9)
    rows, begin, end, labels = S.units_of(*(np.array(x, np.int64) for x in (lines.rows, [ord("N")] * 3, lines.at, lines.size, lines.per, lines.ends, lines.nexts)), np.array(lines.solid), post)
    assert [(r, texts[r][a:b]) for r, a, b in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True)] == [(0, "The one is here."), (0, "The two is there :-)"), (1, "... So is A."), (1, "There is B!"), (2, "So is A."), (2, "There is B! ...")]


def test_units_match_a_plain_walk():
    rng = np.random.RandomState(4)
    for _ in range(300):
        per = rng.randint(0, 5, rng.randint(1, 6))
        solid = rng.rand(int(per.sum()) + len(per)) < 0.7
        post, found, q, s = rng.rand(int(per.sum())), [], 0, 0
        for line, n in enumerate(per.tolist()):
            begin, held, units = 0, False, []
            for j in range(n):
                held = held or solid[s + j]
                if post[q + j] > 0.5 and held:
                    units.append([line, begin, 10 * j + 9])
                    begin, held = 10 * j + 10, False
            if held or solid[s + n]:
                units.append([line, begin, 10 * n + 9])
            elif units:
                units[-1][2] = 10 * n + 9
            found += units
            q, s = q + n, s + n + 1
        place = np.concatenate([np.arange(n) for n in per]).astype(np.int64)
        rows, a, b, _ = S.units_of(np.arange(len(per)), np.zeros(len(per), np.int64), np.zeros(len(per), np.int64), per * 10 + 9, per, place * 10 + 9, place * 10 + 10, solid, post)
        assert np.stack([rows, a, b], 1).tolist() == found


def test_long_words_differ():
    long = "Donaudampfschifffahrtsgesellschaft"
    assert S.left_form(long + "en.") != S.left_form(long + "er.") and S.right_form(long + "en") != S.right_form(long + "er")
    assert [x[2:4] for x in S.places(f"Die {long}. {long}en fährt.")] == [(long + ".", long + "en")]


def fitted_events(sentences_of, joined):
    """A boundary model of lines of one to three sentences."""
    rng = random.Random(5)
    lines = S.Lines([joined.join(rng.choices(sentences_of, k=rng.choice([1, 1, 2, 3]))) for _ in range(400)], A.train_line_model([]))
    return S.events_of(lines)


def cut(text, model):
    return [u[2] for u in S.message_units([text], S.Lines([text], A.train_line_model([])), model)[0]]


def test_boundaries_without_marks():
    latin = ["We meet at noon in the old hall.", "Bring cups and a few chairs.", "Our report is ready for you.", "Please call me after work.", "Thanks for the long letter."]
    model = fitted_events(latin, " ")
    run = [x.rstrip(".").lower() for x in latin]
    assert cut(" ".join(run), model) == run
    assert cut("bring a few cups", model) == ["bring a few cups"]  # no longer than a sentence is
    assert cut(" ".join(latin), model) == latin
    chinese = ["我们周末一起去爬山吧。", "孩子们的学校旅行怎么样？", "邻居把钥匙放在信箱里了。", "请把报告发给我看看。", "会议改到下午三点了。"]
    model = fitted_events(chinese, "")
    run = [x[:-1] for x in chinese]
    assert cut("".join(run), model) == run and cut("".join(chinese), model) == chinese and cut(run[0], model) == [run[0]]


def test_languages():
    texts = ["the cat and the dog", "le chat et le chien", "el gato y el perro", "der Hund und die Katze", "o gato e o cão não", "il gatto e il cane della", "o can e o gato xa unha"]
    langs = ["en", "fr", "es", "de", "pt", "it", "gl"]
    model = L.train_languages(texts * 5, langs * 5)
    score = model.scores([*texts, "привет, как дела", "สวัสดีครับ", "नमस्ते आप", "مرحبا بك", "123 !!"])
    assert [L.LANGS[k] for k in score.argmax(1)[:11]] == [*langs, "ru", "th", "hi", "ar"] and (score[-1] == 0).all()
    assert [L.named_language(x) for x in (" FR ", "fra", "fr-CA", "French", "xx", "", None, "unmatched")] == ["fr"] * 4 + [None] * 4
    assert L.best_path(np.array([[0, -5.0], [-0.3, 0.0], [0, -5.0]])) == [0, 0, 0]


def test_ordinal_regression_orders_bands():
    rng = np.random.RandomState(0)
    x = rng.randn(600, 3)
    y = np.digitize(x[:, 0] * 3 + 0.2 * rng.randn(600), [-1.5, 1.5])
    w, cut = R.fit_ordinal(x, y)
    assert w[0] > 3 * abs(w[1]) and cut[0] < cut[1]
    assert (np.digitize(x @ w, cut) == y).mean() > 0.93
    assert R.text_features("...", "en", {}) is None


def test_connectives_of_several_words():
    at = R.FEATURES.index("connectives")
    of = lambda t, lang: R.text_features(t, lang, {})[at]
    assert of("Sin embargo, vino a casa.", "es") == 1 and of("Vino sin casa ni embargo.", "es") == 0 and of("Uma casa, outra vez.", "pt") == 0 and of("Uma vez em casa, dorme.", "pt") == 1


def test_lines_that_come_again_are_split_once(monkeypatch):
    calls, places = [], S.places
    monkeypatch.setattr(S, "places", lambda text: calls.append(text) or places(text))
    mail, model = "We meet at noon by the old bridge. Bring cups and plates, please.", T.fitted_on([])
    one, many = S.Lines([mail], model).counts(), S.Lines([mail] * 40, model).counts()
    assert calls == [mail, mail]
    key = lambda c, n: sorted(zip(*(c[x] for x in ("kind", "u", "uc", "v", "vc")), (k * n for k in c["n"]), strict=True))
    assert key(one, 40) == key(many, 1)


def test_machines_pass_by_units_beyond_their_margins(monkeypatch):
    stepped, step = [], L.LanguageLearner._step
    monkeypatch.setattr(L.LanguageLearner, "_step", lambda self, *x: stepped.append(len(x[1])) or step(self, *x))
    texts, langs = ["Não temos mais copos para a reunião.", "The total is fine and we have no more cups."] * 2000, ["pt", "en"] * 2000
    vocabulary = L.Vocabulary()
    learner = L.LanguageLearner(vocabulary)
    learner.learn(*vocabulary.tokens_of(texts), np.array([L.LANGS.index(x) for x in langs]))
    assert 0 < sum(stepped) < 1000 and learner.seen.sum() == 4000
    assert learner.model().scores(texts[:2]).argmax(1).tolist() == [L.LANGS.index("pt"), L.LANGS.index("en")]


def test_tokens_of_texts():
    vocabulary = L.Vocabulary()
    texts = ["a b", "x @ y", "", "c", " \t ", f"d {vocabulary.BETWEEN} e", "b a"]
    tokens, sizes = vocabulary.tokens_of(texts)
    assert sizes.tolist() == [2, 3, 1, 1, 1, 2, 2] and tokens[:2].tolist() == tokens[-2:].tolist()[::-1]
    assert vocabulary.tokens_of(["a b", "c"])[0].tolist() == [*tokens[:2].tolist(), tokens[6]]


def test_texts_of_lines_alone():
    for mail in ("Hi \nthere\r\n\n> a \n> b\n-- \nNora ", "one\n two\t\r\n\xa0three", ""):
        assert A.line_texts(mail) == A.line_view(mail)[1]
    assert A._cues("Best wishes, Nora", named=False) == ([], A._cues("Best wishes, Nora")[1])
