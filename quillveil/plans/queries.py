"""The queries of the core library, by name. Each takes a session and a data directory and returns a DataFrame.

All run over whole tables and whole texts. Their SQL counterparts are in `oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillveil.config import Settings
from quillveil.functions import lang as L
from quillveil.functions import text as X
from quillveil.operators import dates as D
from quillveil.operators import entities as E
from quillveil.operators import metrics as M
from quillveil.operators import review as R
from quillveil.operators import timestamps
from quillveil.plans import pipeline
from quillveil.plans.oracles import SQL  # noqa: F401 - part of the contract
from quillveil.runtime import fresh_path, table, work_dir
from quillveil.sinks import files
from quillveil.sources import mail
from quillveil.sources.tabular import map_columns, read_csv

#: Names that all pools together may have; they are collected and become literals.
POOL_ROWS = 10_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, d: str, **columns: Callable[[Column], Column]) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


@query
def mask_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, pseudo_text=pipeline.mask_only)


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_data").filter("message is not null").select("row_id", X.clean_text("message").alias("cleaned"))


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, s=X.split_sentences).select("doc_id", F.posexplode("s").alias("sent_idx", "sentence"))


@query
def sentence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.histogram(_texts(spark, d, s=X.split_sentences), F.size("s"), "n_sentences")


@query
def email_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "email_records").select("record_id", X.mask_emails("content").alias("masked"))


@query
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "email_records").select("record_id", F.posexplode(X.find_emails("content")).alias("idx", "email"))


@query
def sentences_after_email(spark: SparkSession, d: str) -> DataFrame:
    sentences = F.transform(X.split_sentences(X.clean_text("content")), lambda s: X.mask_emails(s))
    return table(spark, d, "email_records").select("record_id", F.posexplode(sentences).alias("sent_idx", "sentence"))


@query
def number_mask(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, masked=X.mask_numbers)


@query
def number_mask_dates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, masked=X.mask_numbers_except_numeric_dates)


@query
def number_mask_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The dates are found first and spared as phrases; the same rows as `number_mask_dates` where no date is glued to digits."""
    return _texts(spark, d, masked=lambda t: X.mask_numbers_except(t, X.find_numeric_dates(t)))


@query
def date_find(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, x=X.find_numeric_dates).select("doc_id", F.posexplode("x").alias("idx", "found"))


@query
def dates_strict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_data").select("row_id", F.posexplode(D.detect_dates("message")).alias("idx", "phrase"))


@query
def dates_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_data").select("row_id", F.posexplode(D.detect_dates("message", "non-strict")).alias("idx", "phrase"))


@query
def strip_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, stripped=X.strip_punctuation, only_punct=X.only_punctuation)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_data").filter("message is not null").select("row_id", F.posexplode(F.split("message", "\n")).alias("line_no", "line"))


@query
def only_numbers_flags(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("row_id", "line_no", X.only_numbers("line").alias("flag"))


@query
def only_emails_flags(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("row_id", "line_no", X.only_emails("line").alias("flag"))


@query
def link_flags(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.split("message", r"\s+"))
    return table(spark, d, "sample_data").select("row_id", words.alias("word")).filter(F.contains("word", F.lit("://"))).select("row_id", "word", X.only_links("word").alias("flag")).groupBy("row_id", "word", "flag").agg(F.count(F.lit(1)).alias("n"))


@query
def lang_guard(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("row_id", "line_no", X.detectable("line").alias("flag"))


@query
def lang_stopword(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, x=L.stopword_language).select("doc_id", F.col("x.lang").alias("lang"), F.round("x.prob", 6).alias("prob"))


@query
def lang_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one label over each sender's messages in the order of their ids, the sender without a name apart."""
    rows = table(spark, d, "sample_data").select(F.coalesce("sender", F.lit("")).alias("sender"), "row_id", "language")
    return L.language_runs(rows, "sender", "row_id", "language").withColumnsRenamed({"begin": "begin_id", "end": "end_id"})


@query
def model_resolution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.model_language("lang").alias("model_lang"))


@query
def field_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sample_data")
    return rows.select("row_id", X.is_usable("subject").alias("subject_used"), X.is_usable("message").alias("message_used"))


@query
def csv_mapping(spark: SparkSession, d: str) -> DataFrame:
    mapped = map_columns(table(spark, d, "sample_data"), ["message", "sent_on", "subject", "row_id", "nothing"], ["content", "date", "title"], "unmatched")
    return mapped.select("content", "date", "title", "row_id")


@query
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "email_records").select("record_id", X.html_to_text("content").alias("bare"))


@query
def gazetteer_ner(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "email_records").select("record_id", F.explode(F.split("content", r"[^\p{L}'’\-]+")).alias("token")).filter("token <> ''")
    found = E.gazetteer_matches(tokens, table(spark, d, "gazetteer"))
    return found.groupBy("record_id", "token", "entity_group").agg(F.count(F.lit(1)).alias("n"))


@query
def gazetteer_spans(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the gazetteer in the contents, those of several words too, with their places; the longest entry wins."""
    ner = E.gazetteer_backend(spark, table(spark, d, "gazetteer"))
    found = table(spark, d, "email_records").select("record_id", F.explode(ner(F.array("content"))).alias("e"))
    return found.select("record_id", F.col("e.start").alias("start_char"), F.col("e.end").alias("end_char"), F.col("e.word").alias("word"), F.col("e.entity_group").alias("entity_group"))


@query
def gazetteer_words(spark: SparkSession, d: str) -> DataFrame:
    """The entries that `gazetteer_spans` finds, numbered in order."""
    w = Window.partitionBy("record_id").orderBy("start_char")
    return gazetteer_spans(spark, d).select("record_id", (F.row_number().over(w) - 1).alias("k"), "word", "entity_group")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities without exact repeats, numbered in order within their record."""
    return table(spark, d, "entity_list").distinct()


@query
def ne_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ent_idx", "start_char", "word", "entity_group"))), lambda e: F.concat(e["word"], F.lit("/"), e["entity_group"])), ";")
    return _entities(spark, d).groupBy("record_id", "field_name", "sent_idx").agg(words.alias("entities"), F.count(F.lit(1)).alias("n"))


def _pools(spark: SparkSession, d: str) -> dict[str, list[str]]:
    pools: dict[str, list[str]] = {}
    rows = table(spark, d, "pseudo_pool").orderBy("lang", "pool_pos").limit(POOL_ROWS + 1).collect()
    if len(rows) > POOL_ROWS:
        raise ValueError(f"the pools have more than {POOL_ROWS} names")
    for r in rows:
        pools.setdefault(r.lang, []).append(r.given_name)
    return pools


@query
def pseudonym_assign(spark: SparkSession, d: str) -> DataFrame:
    """Stand-ins of all entities of a record, in order, from the French pool."""
    pool = _pools(spark, d)["fr"]
    one = F.struct("sent_idx", "ent_idx", "start_char", "word", "entity_group")
    records = _entities(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("ents"))
    chosen = E.choose_pseudonyms("ents", F.array(*map(F.lit, pool)))
    return records.select("record_id", F.posexplode(chosen).alias("idx", "c")).select("record_id", "idx", F.col("c.w").alias("word"), F.col("c.p").alias("pseudonym"))


@query
def pool_exclusion(spark: SparkSession, d: str) -> DataFrame:
    pools = _pools(spark, d)
    people = _entities(spark, d).filter("entity_group = 'PER'").select("word", "record_id", "sent_idx")
    seen = E.first_seen(people, pools, ["record_id", "sent_idx"])
    return seen.select("pool_lang", "name", F.col("seen.record_id").alias("record_id"), F.col("seen.sent_idx").alias("sent_idx"))


@query
def highlight_html(spark: SparkSession, d: str) -> DataFrame:
    """Each record's first person that its content holds, highlighted."""
    people = _entities(spark, d).filter("entity_group = 'PER'").groupBy("record_id").agg(F.min_by("word", F.struct("sent_idx", "ent_idx", "start_char", "word")).alias("word"))
    rows = table(spark, d, "email_records").join(people, "record_id").withColumn("at", R.nth_occurrence(F.col("content"), F.col("word"), 1)).filter("at is not null")
    one = F.array(F.struct("word", F.col("at").alias("start"), (F.col("at") + F.length("word")).alias("end"), F.lit("PER").alias("entity_group")))
    return rows.select("record_id", R.highlight("content", one, {"PER": "lightblue"}).alias("html"))


@query
def highlight_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record's sentences with all its listed entities highlighted, and the number of those whose place isn't there."""
    one = F.struct("sent_idx", F.col("start_char").alias("start"), "word", "entity_group")
    listed = _entities(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("ents"))
    rows = table(spark, d, "email_records").select("record_id", F.transform(X.split_sentences(X.html_to_text("content")), lambda t: X.mask_emails(t)).alias("s")).join(listed, "record_id", "left")
    none = F.array().cast("array<struct<sent_idx:int,start:int,word:string,entity_group:string>>")
    placed = rows.select("record_id", R.place_entities("s", F.coalesce("ents", none)).alias("p"))
    colors = {"PER": "lightblue", "LOC": "lightgreen", "ORG": "orange", "MISC": "plum"}
    return placed.select("record_id", R.highlight_record("p.sentences", "p.entities", colors).alias("html"), F.col("p.unplaced").alias("unplaced"))


@query
def correction_apply(spark: SparkSession, d: str) -> DataFrame:
    """People's edits, made up by rule: entities without a score go, MISC become PER, persons of several words lose the first."""
    keys = ["record_id", "field_name", "sent_idx", "ent_idx", "start_char"]
    least = F.min(F.struct("word", "entity_group", "end_char", F.coalesce("score", F.lit(-1.0)).alias("score")))
    unique = _entities(spark, d).groupBy(*keys).agg(least.alias("x")).select(*keys, "x.*")
    remove = unique.filter("score < 0").select(*keys, F.lit("remove").alias("action"), "entity_group", "word", "end_char")
    regroup = unique.filter("score >= 0 and entity_group = 'MISC'").select(*keys, F.lit("regroup").alias("action"), F.lit("PER").alias("entity_group"), "word", "end_char")
    shorter = F.regexp_replace("word", "^[^ ]* ", "")
    reword = unique.filter("score >= 0 and entity_group = 'PER' and contains(word, ' ')").select(*keys, F.lit("reword").alias("action"), "entity_group", shorter.alias("word"), "end_char")
    fixed = R.apply_corrections(unique, remove.unionByName(regroup).unionByName(reword), keys)
    return fixed.select(*keys, "entity_group", "word", "end_char")


@query
def mask_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders for mail addresses in the masked text against those for everything with an @."""
    rows = table(spark, d, "sample_data").filter("message is not null")
    counts = rows.select(M.mask_counts(X.mask_emails("message"), F.regexp_replace("message", r"[^ \n\r<>()]*@[^ \n\r<>()]*", "[email]"), "[email]").alias("c")).select("c.*")
    return _rounded(M.scores(counts))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query
def entity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Persons that the gazetteer finds as words against those of the entity list."""
    listed = _entities(spark, d).filter("entity_group = 'PER'").select("record_id", F.explode(F.split("word", r"[^\p{L}'’\-]+")).alias("token")).filter("token <> ''").groupBy("record_id").agg(F.collect_set("token").alias("gold"))
    found = gazetteer_ner(spark, d).filter("entity_group = 'PER'").groupBy("record_id").agg(F.collect_set("token").alias("found"))
    both = table(spark, d, "email_records").select("record_id").join(listed, "record_id", "left").join(found, "record_id", "left")
    return _rounded(M.scores(both.select(M.set_counts("found", "gold").alias("c")).select("c.*")))


@query
def dedupe_join_union(spark: SparkSession, d: str) -> DataFrame:
    """File names of both tables, once each, with the number of deliveries and the attachments that their record counts."""
    samples, records = table(spark, d, "sample_data").select("file_name"), table(spark, d, "email_records").select("file_name", "attachment")
    names = samples.unionByName(records.select("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return M.validated_join(names, records, ["file_name"])


@query
def bio_to_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of capitalised tokens as BIO tags, and the spans of them."""
    tokens = F.filter(F.split("text", "[ \n]+"), lambda t: t != "")
    capital = lambda t: t.rlike("^[A-Z]")
    tag = lambda words: F.transform(words, lambda t, k: F.when(~capital(t), "O").when((k > 0) & capital(F.get(words, k - 1)), "I-CAP").otherwise("B-CAP"))
    tags = M.bound(tokens, tag)
    spans = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(M.bio_spans(tags)).alias("s"))
    return spans.select("doc_id", F.col("s.type").alias("type"), F.col("s.first").alias("first"), F.col("s.last").alias("last"))


@query
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.filter(F.split("content", " "), lambda t: t != "")
    rows = table(spark, d, "email_records").select("record_id", F.posexplode(M.token_offsets("content", tokens)).alias("k", "t"))
    return rows.select("record_id", "k", F.col("t.token").alias("token"), F.col("t.start").alias("start_char"), F.col("t.end").alias("end_char"))


@query
def detokenized(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, joined=lambda t: X.detokenize(F.regexp_replace(t, r"([.,!?;:()])", " $1 ")))


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as CSV and read again with mapped columns; CSV tells null from empty no more."""
    path = fresh_path(spark, "csv")
    files.write_csv(table(spark, d, "sample_data").select("row_id", "message", "subject", "sender"), path)
    back = read_csv(spark, path, ["message", "subject", "row_id", "lost"], ["content", "title", "row_id", "none"])
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), "content", "title", "none")


@query
def xml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as XML with the kinds of their values and read again."""
    path = fresh_path(spark, "xml")
    files.write_xml(table(spark, d, "email_records").select("record_id", "file_name", "attachment", "attachment_type"), path)
    value = "struct<_VALUE:string,_type:string>"
    schema = f"record_id {value}, file_name {value}, attachment {value}, attachment_type struct<_type:string,item:array<{value}>>"
    back = spark.read.format("xml").option("rowTag", "email").schema(schema).load(path)
    return back.select(F.col("record_id._VALUE").cast("bigint").alias("record_id"), F.col("record_id._type").alias("kind"), F.col("file_name._VALUE").alias("file_name"), F.col("attachment._VALUE").cast("int").alias("attachment"),
                       F.coalesce(F.array_join(F.transform("attachment_type.item", lambda x: x["_VALUE"]), ","), F.lit("")).alias("kinds"))


@query
def mail_decode(spark: SparkSession, d: str) -> DataFrame:
    """Records made to mails (base64 text, an attachment for each listed kind) and decoded again; texts with tags are left to `html_text`."""
    encoded = lambda c: F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(c, "utf-8")), F.lit("?="))
    rows = table(spark, d, "email_records").filter("not contains(content, '<')")
    body = F.concat(F.lit("--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode("content", "utf-8")))
    part = lambda k: F.concat(F.lit("\r\n--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\"a."), k, F.lit("\"\r\n\r\nx"))
    parts = F.array_join(F.transform(F.coalesce("attachment_type", F.array().cast("array<string>")), part), "")
    subject = F.coalesce(F.concat(F.lit("Subject: "), encoded(F.col("subject")), F.lit("\r\n")), F.lit(""))
    date = F.coalesce(F.concat(F.lit("Date: "), F.date_format("date", "d MMM yyyy HH:mm:ss"), F.lit(" +0000\r\n")), F.lit(""))
    raw = F.concat(F.lit("MIME-Version: 1.0\r\n"), subject, date, F.lit("Content-Type: multipart/mixed; boundary=b\r\n\r\n"), body, parts, F.lit("\r\n--b--\r\n"))
    mails = rows.select(F.concat(F.lit("/"), F.col("record_id").cast("string")).alias("path"), F.encode(raw, "utf-8").alias("content"))
    found = mails.mapInPandas(mail._decode, mail.SCHEMA)
    return found.select(F.col("file_name").cast("bigint").alias("record_id"), "content", "subject", F.unix_seconds("date").alias("sent"), "attachment", F.array_join("attachment_type", ",").alias("kinds"))


@query
def field_completion(spark: SparkSession, d: str) -> DataFrame:
    return mail.complete_fields(table(spark, d, "email_records").select("record_id", "subject"), ["subject", "sender", "lang"])


@query
def pool_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The pool that serves each document's language: its size and the name at each place of the first three."""
    pools = _pools(spark, d)
    pool = E.pool_for("lang", pools)
    return table(spark, d, "documents").select("doc_id", E.pool_language("lang", pools).alias("pool_lang"), F.size(pool).alias("n"), F.array_join(F.slice(pool, 1, 3), ",").alias("names"))


@query
def entities_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Records' entities by the number of their sentence, as the pipeline gives them out."""
    one = F.struct("sent_idx", "start_char", "word", "entity_group")
    records = _entities(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    by = E.entities_by_sentence("e", F.array_max(F.transform("e", lambda x: x["sent_idx"])) + 1)
    pairs = records.select("record_id", F.explode(by).alias("sent", "found"))
    return pairs.select("record_id", F.col("sent").cast("int").alias("sent_idx"), F.size("found").alias("n"), F.array_join(F.transform("found", lambda x: x["word"]), ";").alias("words"))


@query
def replaced_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses of the contents as entities with pseudonyms of other lengths, replaced by their places."""
    text = X.html_to_text("content")
    spans = D.find_spans(F.col("t"), X.EMAIL)
    given = F.transform(spans, lambda s, k: F.struct(F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"]).alias("word"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), k.cast("string"), F.lit(">")).alias("pseudonym")))
    rows = table(spark, d, "email_records").select("record_id", F.when(~F.contains("content", F.lit("<")), text).alias("t"))
    return rows.filter("t is not null").select("record_id", E.replace_entities("t", given).alias("replaced"))


@query
def names_across_fields(spark: SparkSession, d: str) -> DataFrame:
    """Persons of a record's first sentence as its first field, all others as its second: names stay linked across both."""
    pool = F.array(*map(F.lit, _pools(spark, d)["fr"]))
    one = F.struct("sent_idx", "ent_idx", "start_char", "word", "entity_group")
    records = _entities(spark, d).filter("entity_group = 'PER'").groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    split = records.select("record_id", F.filter("e", lambda x: x["sent_idx"] == 0).alias("a"), F.filter("e", lambda x: x["sent_idx"] > 0).alias("b")).withColumn("first", E.choose_pseudonyms("a", pool))
    both = split.withColumn("second", E.choose_pseudonyms("b", pool, F.col("first")))
    linked = F.size(F.filter("second", lambda y: F.exists("first", lambda x: x["w"] == y["w"])))
    kept = F.size(F.filter("second", lambda y: F.exists("first", lambda x: (x["w"] == y["w"]) & (x["p"] == y["p"]))))
    return both.select("record_id", F.size("first").alias("n_first"), F.size("second").alias("n_second"), linked.alias("n_met_before"), kept.alias("n_kept"))


@query
def gold_mask(spark: SparkSession, d: str) -> DataFrame:
    """Contents with the addresses that were found in them masked as literal strings."""
    return table(spark, d, "email_records").select("record_id", X.literal_mask("content", F.array_distinct(X.find_emails("content")), "[email]").alias("masked"))


@query
def iob_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of words and tags (capitalised words are tagged), parsed again."""
    words = F.filter(F.split(F.regexp_replace("text", r"(?U)\s+", " "), " "), lambda w: w != "")
    tags = F.transform(words, lambda w: F.when(w.rlike("^[A-Z]"), "B-cap").otherwise("O"))
    line = F.concat(F.lit("BOS "), F.array_join(words, " "), F.lit(" EOS\tO "), F.array_join(tags, " "), F.lit(" intent"))
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(words).alias("n"), M.parse_iob_line(line).alias("p")).filter("n > 0")
    return rows.select("doc_id", F.posexplode(F.arrays_zip("p.tokens", "p.tags")).alias("k", "x")).select("doc_id", "k", F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"))


@query
def entities_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Each record's entities in falling order of score, those without one last, ties by place and word."""
    w = Window.partitionBy("record_id").orderBy(F.desc_nulls_last("score"), "sent_idx", "start_char", "word", "entity_group", "end_char", "ent_idx", "field_name")
    return _entities(spark, d).select("record_id", "word", "entity_group", "score", F.row_number().over(w).alias("place"))


@query
def repseudonymized(spark: SparkSession, d: str) -> DataFrame:
    """Contents as one sentence whose found addresses were corrected to persons: replaced anew from the French pool."""
    pool = F.array(*map(F.lit, _pools(spark, d)["fr"]))
    rows = table(spark, d, "email_records").filter("not contains(content, '<')").select("record_id", F.col("content").alias("t"))
    spans = D.find_spans(F.col("t"), X.EMAIL)
    found = F.transform(spans, lambda s: F.struct(F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"]).alias("word"), F.lit("PER").alias("entity_group"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("sent_idx")))
    only = F.filter(found, lambda e: e["start"] == found[0]["start"])  # the first address; it gets the pool's first name
    return rows.select("record_id", R.repseudonymize(F.array("t"), only, pool)[0].alias("replaced"))


def _record_settings(spark: SparkSession, d: str, default_lang: str) -> Settings:
    return Settings(default_lang=default_lang, pseudo_first_names=_pools(spark, d))


@query
def pipeline_masks(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline without a recogniser: sentences, mail addresses and numbers masked, dates with their times spared."""
    settings = Settings(pseudo_fields=("content",), pseudo_ne=False)
    rows = table(spark, d, "email_records").select("record_id", X.html_to_text("content").alias("content"))
    out = pipeline.pseudonymize(rows, settings, "record_id")
    n = lambda c: F.coalesce(F.size(F.element_at(c, "content")), F.lit(0))
    return out.select("record_id", "pseudo_content", n("detected_datetime").alias("n_dates"), n("sentences").alias("n_sentences"), F.element_at("lang", "content").alias("lang"))


@query
def pseudonymize_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over subjects and contents of the records, with languages told by stop words."""
    settings = _record_settings(spark, d, "")
    ner = E.gazetteer_backend(spark, table(spark, d, "gazetteer"))
    rows = table(spark, d, "email_records").select("record_id", "subject", X.html_to_text("content").alias("content"))
    # Small pools may shrink to nothing on real names; what is left then has one stand-in.
    out = pipeline.pseudonymize(rows, settings, "record_id", ner, languages="stopwords", used_up="Inconnu")
    return out.select("record_id", "pseudo_subject", "pseudo_content", F.to_json("lang").alias("lang"), F.to_json("ne_sent").alias("ne_sent"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of parsed texts stays in the shared work folder, so that a later run parses only what is new."""
    return timestamps.p1_found(spark, table(spark, d, "sample_data"), table(spark, d, "mailboxes"), f"{work_dir(spark)}/quillveil/timestamp-dictionary")


@query
def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its instant as a timestamp, null where the text names none."""
    rows = table(spark, d, "sample_data").select("row_id", "date")
    found = p1_found(spark, d)
    return rows.join(found, "row_id", "left").select("row_id", "date", F.timestamp_micros("utc_micros").alias("instant"))


