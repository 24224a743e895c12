"""Queries on data: sources and sinks, records, preparation, generators, translation checks, the training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions import text as TX
from tarazu.functions.seeded import h32
from tarazu.operators import generate as G
from tarazu.operators import groups as GR
from tarazu.operators import mix as M
from tarazu.operators import prep as P
from tarazu.operators import qa as Q
from tarazu.operators import records as R
from tarazu.plans.registry import Data, query
from tarazu.sources import io
from tarazu.sources.shared import shared_path
from tarazu.streaming.resume import process_available


def folder(d: Data, what: str) -> str:
    """A new folder that driver and executors share, dropped when the session ends."""
    return shared_path(d.spark, what)


def values(d: Data, columns: str, *rows: tuple) -> DataFrame:
    """A small literal table; unlike one made of Python rows its size is known, so Spark can broadcast it."""
    plain = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    return d.spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(plain, r)) + ')' for r in rows)} t({columns})")


def records(d: Data) -> DataFrame:
    f = d.fx_docs
    opts = R.option_array(*M.YES_NO)
    licence = F.element_at(F.array(*[F.lit(x) for x in LICENSES]), (F.col("sn") + 1).cast("int"))
    return R.rec_map(f, {
        "id": F.col("id"), "source_id": F.col("source_id"), "source": F.col("source"), "revision": F.lit("r1"), "license": licence, "split": F.col("split"), "origin": F.col("origin"), "state_lang": F.col("lang"),
        "question_lang": F.lit("en"), "state": F.col("text"), "question_type": F.lit("noul"), "question_text": F.concat(F.lit("Is it "), "task", F.lit("?")), "options": opts, "gold": R.one_hot(opts, F.col("label")),
        "flags": F.struct(F.lit(True).alias("auto_ok"), F.lit(False).alias("meaning_flag"), F.lit(False).alias("reviewed")),
    })


#: Licences in the order of the sources, and what each allows.
LICENSES = ("Apache-2.0", "MIT", "CC-BY-NC-SA-4.0", "GPL-3.0", "CC-BY-ND-4.0")
_LICENSE = "['Apache-2.0', 'MIT', 'CC-BY-NC-SA-4.0', 'GPL-3.0', 'CC-BY-ND-4.0'][sn + 1]"


def policy(d: Data) -> DataFrame:
    rows = [("Apache-2.0", "open", True, True, True), ("MIT", "open", True, True, True), ("CC-BY-NC-SA-4.0", "NC", False, True, False), ("GPL-3.0", "GPL", True, True, False), ("CC-BY-ND-4.0", "ND", False, False, False)]
    return values(d, "license, kind, allow_train, allow_test, allow_release", *rows)


def shown(df: DataFrame, *more: str) -> DataFrame:
    """Options and gold as text, in the order of the options."""
    opts = F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"])), ";")
    gold = F.array_join(F.transform("options", lambda o: F.element_at("gold", o["id"]).cast("string")), ";")
    return df.select("id", *more, opts.alias("opts"), gold.alias("golds"))


_GOLD = "CASE WHEN label = 'yes' THEN '1.0;0.0' ELSE '0.0;1.0' END"

# sources and sinks


@query("SELECT doc_id, text, source_name AS source, 'r7' AS revision, 'MIT' AS license FROM (SELECT doc_id, text, 'own' AS source_name FROM documents)")
def src_read_pinned(d: Data):
    return io.read_pinned(d.spark, f"{d.dir}/documents.parquet", "parquet", "doc_id long, text string", "own", "r7", "MIT")


@query("SELECT event_id, cast(props->>'$.k' AS bigint) AS k, props->>'$.none' AS absent FROM events")
def src_parse_state(d: Data):
    return io.parse_state(d.events, {"k": ("$.k", "long"), "absent": ("$.none", "string")}, "props").select("event_id", "k", "absent")


@query("SELECT split, source, count(*) AS n, count(DISTINCT source_id) AS cases FROM fx_docs GROUP BY 1, 2")
def snk_records(d: Data):
    path = folder(d, "records")
    io.write_records(records(d), path)
    return d.spark.read.parquet(path).groupBy("split", "source").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("cases"))


@query("SELECT run AS run_id, count(*) AS n, round(sum(score), 4) AS total FROM fx_long WHERE idx = 0 GROUP BY 1")
def snk_predictions(d: Data):
    path = folder(d, "predictions")
    p = d.fx_long.where("idx = 0").select(F.col("run").alias("run_id"), "id", "score")
    io.write_predictions(p.where("run_id < 2"), path)
    io.write_predictions(p.where("run_id >= 2"), path)
    return d.spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("SELECT run_id, metric, step, round(value, 6) AS value FROM fx_curve WHERE NOT isnan(value)")
def src_run_logs(d: Data):
    csv, js = folder(d, "logs-csv"), folder(d, "logs-json")
    c = d.fx_curve.where("not isnan(value)").select("run_id", "step", "metric", "value")
    c.where("metric = 'loss'").write.csv(csv, header=True)
    c.where("metric <> 'loss'").write.json(js)
    both = io.read_run_logs(d.spark, csv, "csv").unionByName(io.read_run_logs(d.spark, js, "json"))
    return both.select("run_id", "metric", "step", F.round("value", 6).alias("value"))


@query("SELECT id, length(text) AS state_length, concat('Is it ', task, '?') AS question, 2 AS n_options, round(p, 6) AS p_yes FROM (SELECT f.id, f.text, f.task, p.p FROM fx_docs f JOIN fx_p p ON f.id = p.id AND p.run = 1 AND p.idx = 0)")
def src_bench_format(d: Data):
    req = io.to_bench_request(records(d))
    parsed = req.select("id", F.from_json("request", "state string, question struct<type:string,text:string,options:array<struct<id:string,text:string>>>").alias("r"))
    answers = d.fx_p.where("run = 1").groupBy("id").agg(F.to_json(F.struct("id", F.map_from_entries(F.collect_list(F.struct("option_id", "p"))).alias("probabilities"))).alias("response"))
    resp = io.from_bench_response(answers)
    return parsed.join(resp, "id").select("id", F.length("r.state").alias("state_length"), F.col("r.question.text").alias("question"), F.size("r.question.options").alias("n_options"), F.round(F.element_at("pred", "yes"), 6).alias("p_yes"))


@query("SELECT cast(doc_id AS varchar) AS source_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(d: Data):
    cases = d.documents.select(F.col("doc_id").cast("string").alias("source_id"), "lang")
    return io.pending(cases, d.labels.select(F.col("doc_id").cast("string").alias("source_id")))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def resume_stream(d: Data):
    src, out, ckpt = folder(d, "stream-in"), folder(d, "stream-out"), folder(d, "stream-ckpt")
    docs = d.documents.select("doc_id", "lang", "n_chars")
    docs.where("doc_id % 2 = 0").write.mode("append").parquet(src)
    step = lambda b: b.withColumn("done", F.lit(True))
    process_available(d.spark, src, out, ckpt, docs.schema, step, case=["doc_id"])
    docs.write.mode("append").parquet(src)  # the even ones come again
    process_available(d.spark, src, out, ckpt, docs.schema, step, case=["doc_id"])
    return d.spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# records


@query(f"SELECT id, source_id, license, split, origin, question_type, question_text, opts, golds FROM (SELECT id, source_id, {_LICENSE} AS license, split, origin, 'noul' AS question_type, concat('Is it ', task, '?') AS question_text, 'yes=Yes;no=No' AS opts, {_GOLD} AS golds FROM fx_docs)")
def rec_map(d: Data):
    return shown(records(d), "source_id", "license", "split", "origin", "question_type", "question_text")


@query("SELECT source_id, CASE WHEN task = 'quality' THEN 0 ELSE 1 END AS position, task, label FROM fx_docs")
def case_to_decisions(d: Data):
    f = d.labels.select(F.col("doc_id").cast("string").alias("source_id"), F.array(*[F.struct(F.lit(t).alias("task"), F.when(F.col(t) == 1, "yes").otherwise("no").alias("label")) for t in ("quality", "toxic")]).alias("decisions"))
    return R.case_to_decisions(f.join(d.documents.select(F.col("doc_id").cast("string").alias("source_id")), "source_id"))


@query("SELECT id, idx, option_id, g FROM fx_long WHERE run = 0")
def explode_options(d: Data):
    return R.explode_options(records(d)).select("id", "idx", "option_id", "g")


@query(f"SELECT id, 'yes=Yes;no=No' AS opts, CASE WHEN sn = 0 THEN '0.25;0.75' ELSE {_GOLD} END AS golds FROM fx_docs")
def gold_one_hot(d: Data):
    r = records(d).drop("gold").join(d.fx_docs.select("id", "label", "sn"), "id")
    soft = F.when(F.col("sn") == 0, F.create_map(F.lit("yes"), F.lit(0.25), F.lit("no"), F.lit(0.75)))
    return shown(R.gold_one_hot(r.withColumn("gold", soft), "label"))


@query("""SELECT id, concat_ws(',', CASE WHEN sn = 1 THEN 'gold_sum' END, CASE WHEN sn = 2 THEN 'origin' END, CASE WHEN sn = 3 THEN 'split' END, CASE WHEN sn = 4 THEN 'duplicate_id' END) AS violations
    FROM (SELECT id, sn FROM fx_docs UNION ALL SELECT id, sn FROM fx_docs WHERE sn = 4) WHERE sn BETWEEN 1 AND 4""")
def rec_validate(d: Data):
    r = records(d).join(d.fx_docs.select("id", "sn"), "id")
    r = r.withColumn("gold", F.when(F.col("sn") == 1, F.transform_values("gold", lambda k, v: v / 2)).otherwise(F.col("gold")))
    r = r.withColumn("origin", F.when(F.col("sn") == 2, "unknown").otherwise(F.col("origin"))).withColumn("split", F.when(F.col("sn") == 3, None).otherwise(F.col("split")))
    return R.rec_validate(r.unionByName(r.where("sn = 4")))


@query("SELECT source, split, origin, question_type, count(*) AS n, count(DISTINCT source_id) AS cases, grouping_id(source, split, origin, question_type) AS level FROM (SELECT *, 'noul' AS question_type FROM fx_docs) GROUP BY GROUPING SETS ((source, split, origin, question_type), (source, split), (source), ())")
def dataset_profile(d: Data):
    return R.dataset_profile(records(d))


_ROW = "cast('0x' || substr(md5(concat(" + ", ".join(f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')" for c in ("doc_id", "lang", "text")) + ")), 1, 15) AS bigint)"


@query(f"SELECT count(*) AS n, cast(sum({_ROW}::HUGEINT) % {R.PRIME} AS bigint) AS version FROM documents")
def dataset_version_hash(d: Data):
    return R.dataset_version_hash(d.documents, ["doc_id", "lang", "text"])


@query("SELECT doc_id AS id, CASE WHEN doc_id % 31 = 1 THEN 'removed' WHEN doc_id % 31 = 2 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 31 IN (1, 2, 3)")
def dataset_version_diff(d: Data):
    """Documents against a version without some, with others new and others' texts changed."""
    old = d.documents.where("doc_id % 31 <> 2")
    new = d.documents.where("doc_id % 31 <> 1").withColumn("text", F.when(F.col("doc_id") % 31 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.version_diff(old, new, ["doc_id", "lang", "text"], "doc_id")


@query("SELECT id FROM fx_docs WHERE sn IN (0, 1)")
def license_release_filter(d: Data):
    return R.license_release_filter(records(d), policy(d), "release").select("id")


@query("SELECT split, ['', '', 'NC', 'GPL', 'ND'][sn + 1] AS kind, count(*) AS n, cast(sum(CASE WHEN split = 'train' AND sn <> 3 THEN 1 ELSE 0 END) AS bigint) AS bad FROM fx_docs WHERE sn >= 2 GROUP BY 1, 2")
def license_audit(d: Data):
    return R.license_audit(records(d), policy(d))


# preparation

_KEY = "md5(trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_KEY.format('text')}")
def dedup_exact(d: Data):
    return R.dedup_exact(d.documents.select("doc_id", "text"), TX.text_key(F.col("text")), "doc_id").select("doc_id")


@query("SELECT id, task, label FROM (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY H32(concat('5:', id)), id) AS r FROM fx_docs) WHERE r <= 20")
def sample_balanced(d: Data):
    return P.sample_balanced(d.fx_docs, ["task", "label"], 20, 5).select("id", "task", "label")


@query("SELECT doc_id FROM documents ORDER BY H32(concat('3:', cast(doc_id AS varchar))), doc_id LIMIT 50")
def sample_fixed(d: Data):
    return P.sample_fixed(d.documents, 50, 3, "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_KEY.format('text')} IN (SELECT {_KEY.format('text')} FROM fx_docs WHERE split = 'test')")
def overlap_check(d: Data):
    return P.overlap_check(d.documents.select("doc_id", F.col("text").alias("state")), d.fx_docs.select("split", F.col("text").alias("state"))).select("doc_id")


@query(r"""SELECT page_id, field, class, CASE WHEN field = 'html' THEN 'keep' WHEN class = 'text' THEN 'translate' ELSE 'keep' END AS action FROM (SELECT page_id, field, CASE WHEN regexp_matches(v, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+$') THEN 'email' WHEN regexp_matches(v, '^https?://\S+$') THEN 'url' WHEN regexp_matches(v, '[{};]\s*$|^\s*(def|class|import|return)\b') THEN 'code' WHEN regexp_matches(v, '^[#A-Z-]*[0-9][0-9,.-]*$') THEN 'number' ELSE 'text' END AS class
    FROM (SELECT page_id, 'url' AS field, url AS v FROM pages UNION ALL SELECT page_id, 'title', coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '') FROM pages UNION ALL SELECT page_id, 'number', cast(page_id AS varchar) FROM pages))""")
def field_rules(d: Data):
    p = d.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("page_id").alias("number"))
    rules = values(d, "field, action", ("html", "keep"))
    return P.field_rules(p, ["url", "title", "number"], rules, "page_id").drop("value")


@query(r"SELECT cast(doc_id AS varchar) AS source_id, bool_or(regexp_matches(text, '[$€£]\s?[0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+\s?%|(over|under|above|below|more than|less than|at least)\s+[0-9]')) AS numeric FROM documents GROUP BY 1")
def flag_numeric_cases(d: Data):
    return P.flag_numeric_cases(d.documents.select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("state")))


_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
def _tokens(table: str, keys: str, text: str) -> str:
    return f"SELECT {keys}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {keys}, {_WORDS.format(text)} AS w FROM {table})"


_GLOSSARY = "(VALUES ('the', 'der'), ('and', 'und'), ('of', 'von'), ('of the', 'von der')) g(en_term, fa_term)"


def glossary(d: Data) -> DataFrame:
    return values(d, "en_term, fa_term", ("the", "der"), ("and", "und"), ("of", "von"), ("of the", "von der"))


def _terms(table: str, keys: str, text: str) -> str:
    """A row for each term of the glossary that occurs: the phrase, or a word outside it."""
    near = f"SELECT *, lead(w) OVER o AS after, lag(w) OVER o AS before FROM ({_tokens(table, 'row, ' + keys, text)}) WINDOW o AS (PARTITION BY row ORDER BY i)"
    term = "CASE WHEN w = 'of' AND after = 'the' THEN 'of the' WHEN w = 'the' AND before = 'of' THEN NULL WHEN w IN ('the', 'and', 'of') THEN w END"
    return f"SELECT row, {keys}, {term} AS en_term FROM ({near})"


@query(f"SELECT doc_id, en_term, count(*) AS n FROM ({_terms('(SELECT *, row_number() OVER () AS row FROM documents)', 'doc_id', 'text')}) WHERE en_term IS NOT NULL GROUP BY 1, 2")
def glossary_terms(d: Data):
    return P.glossary_terms(d.documents, glossary(d), "text", "doc_id")


@query("SELECT conv_id, turn, role AS field, CASE WHEN role = 'user' THEN 'colloquial' ELSE 'formal' END AS register FROM conversations")
def register_rule(d: Data):
    rules = values(d, "field, register", ("user", "colloquial"))
    return P.register_rule(d.conversations.select("conv_id", "turn", F.col("role").alias("field")), rules)


@query("SELECT id, split FROM fx_docs")
def split_by_source(d: Data):
    return P.split_by_source(d.fx_docs.drop("split")).select("id", "split")


@query("SELECT source_id, count(DISTINCT s) AS splits FROM (SELECT source_id, CASE WHEN doc_id % 11 = 0 AND task = 'toxic' THEN 'other' ELSE split END AS s FROM fx_docs) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def split_integrity(d: Data):
    return P.split_integrity(d.fx_docs.withColumn("split", F.when((F.col("doc_id") % 11 == 0) & (F.col("task") == "toxic"), "other").otherwise(F.col("split"))))


@query(f"SELECT id FROM fx_docs WHERE split = 'train' AND ({_KEY.format('text')} IN (SELECT {_KEY.format('text')} FROM fx_docs WHERE split = 'test') OR source_id IN (SELECT source_id FROM fx_docs WHERE split = 'test'))")
def leak_exact(d: Data):
    f = d.fx_docs.select("id", "source_id", "split", F.col("text").alias("state"))
    return P.leak_exact(f.where("split = 'train'"), f.where("split = 'test'")).select("id")


def _shingles(table: str, key: str) -> str:
    gram = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 5)) + ")"
    every = f"SELECT {key}, CASE WHEN z IS NOT NULL THEN g WHEN i = 1 THEN concat(' ', g) END AS g FROM (SELECT {key}, i, {gram} AS g, lead(w, 4) OVER o AS z FROM ({_tokens(table, key, 'text')}) WINDOW o AS (PARTITION BY {key} ORDER BY i))"
    return f"SELECT DISTINCT {key} AS id, cast('0x' || substr(md5(g), 1, 15) AS bigint) AS sh FROM ({every}) WHERE g IS NOT NULL"


_SIM = f"""WITH a AS ({_shingles('documents', 'doc_id')}), b AS ({_shingles('benchmark', 'item_id')}), na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
    x AS (SELECT b.id AS test_id, a.id AS train_id, count(*) AS shared FROM a JOIN b ON a.sh = b.sh GROUP BY 1, 2), s AS (SELECT x.*, shared::DOUBLE / (na.n + nb.n - shared) AS jaccard, shared::DOUBLE / nb.n AS containment FROM x JOIN na ON x.train_id = na.id JOIN nb ON x.test_id = nb.id) """


def leaks(d: Data) -> tuple[DataFrame, DataFrame]:
    return d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("state")), d.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("state"))


@query(_SIM + "SELECT test_id, train_id, shared, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM s WHERE jaccard >= 0.8 OR containment >= 0.5")
def leak_near_dup(d: Data):
    return P.leak_near_dup(*leaks(d)).withColumn("jaccard", F.round("jaccard", 6)).withColumn("containment", F.round("containment", 6))


@query(_SIM.replace(_shingles('benchmark', 'item_id'), _shingles('fx_tests', 'id')) + "SELECT test_id, train_id, round(jaccard, 6) AS jaccard FROM s WHERE jaccard >= 0.8")
def leak_minhash(d: Data):
    """Benchmark items and every twentieth document, with words added, against all documents."""
    return P.leak_minhash(leaks(d)[0], d.fx_tests.withColumnRenamed("text", "state")).withColumn("jaccard", F.round("jaccard", 6))


_LINKED = f"""WITH RECURSIVE s AS ({_shingles("(SELECT DISTINCT source_id, text FROM fx_docs)", "source_id")}), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
    e AS (SELECT x.id AS a, y.id AS b FROM (SELECT s.*, n FROM s JOIN z ON s.id = z.id) x JOIN (SELECT s.*, n FROM s JOIN z ON s.id = z.id) y ON x.sh = y.sh AND x.id <> y.id GROUP BY 1, 2 HAVING count(*) >= 0.8::DOUBLE * (max(x.n) + max(y.n) - count(*)) - 1e-9),
    r AS (SELECT DISTINCT source_id AS a, source_id AS b FROM fx_docs UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a, min(b) AS root FROM r GROUP BY 1) """


@query(_LINKED + """SELECT id, root AS "group", CASE WHEN h < 80 THEN 'train' WHEN h < 88 THEN 'validation' WHEN h < 92 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT f.id, g.root, H32(concat('0:', g.root)) % 100 AS h FROM fx_docs f JOIN g ON f.source_id = g.a)""")
def split_by_group(d: Data):
    """The split with near copies on one side."""
    f = d.fx_docs.withColumnRenamed("text", "state")
    once = f.where("task = 'quality'").select("source_id", "state")  # a case's text is that of both its tasks
    return GR.split_by_group(f, GR.near_copy_links(once)).select("id", "group", "split")


_KEPT = "list_distinct(regexp_extract_all(translate(coalesce({}, ''), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '" + P.KEPT + "'))"


@query(f"""WITH a AS (SELECT row, id, unnest(k) AS t FROM (SELECT row_number() OVER () AS row, source_id AS id, {_KEPT.format('target_text')} AS k FROM fx_pairs WHERE rule = 'translate') WHERE len(k) >= 2), b AS (SELECT row, id, unnest(k) AS t FROM (SELECT row_number() OVER () AS row, doc_id AS id, {_KEPT.format('text')} AS k FROM documents) WHERE len(k) >= 2),
    n AS (SELECT (SELECT count(DISTINCT row) FROM a) + (SELECT count(DISTINCT row) FROM b) AS n), w AS (SELECT t, ln(1 + any_value(n)::DOUBLE / count(*)) AS w FROM (SELECT t FROM a UNION ALL SELECT t FROM b), n GROUP BY 1),
    wa AS (SELECT a.*, w FROM a JOIN w USING (t)), wb AS (SELECT b.*, w FROM b JOIN w USING (t)), sa AS (SELECT row, sum(w) AS s FROM wa GROUP BY 1), sb AS (SELECT row, sum(w) AS s FROM wb GROUP BY 1),
    x AS (SELECT wb.row AS br, wa.row AS ar, any_value(wb.id) AS test_id, any_value(wa.id) AS train_id, count(*) AS shared, sum(wa.w) AS w FROM wa JOIN wb USING (t) GROUP BY 1, 2)
    SELECT DISTINCT test_id, train_id, shared, round(x.w / (sa.s + sb.s - x.w), 6) AS overlap FROM x JOIN sa ON ar = sa.row JOIN sb ON br = sb.row WHERE shared >= 2 AND x.w / (sa.s + sb.s - x.w) >= 0.8 - 1e-9""")
def leak_translated(d: Data):
    """Each document searched among the translations of all."""
    train = d.fx_pairs.where("rule = 'translate'").select(F.col("source_id").alias("id"), F.col("target_text").alias("state"))
    test = d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("state"))
    return P.leak_translated(train, test).withColumn("overlap", F.round("overlap", 6))


# generators: facts come from the tables' dates, amounts and times

_LEAPS = "(8 * cast(floor(({y}) / 33.0) AS bigint) + len(list_filter([1, 5, 9, 13, 17, 22, 26, 30], lambda k: ({y}) % 33 > k)))"
_DIM = f"""SELECT jy, n, date '2020-03-20' + cast(365 * (jy - 1399) + {_LEAPS.format(y="jy")} - {_LEAPS.format(y="1399")} + n AS int) AS g FROM (SELECT jy, unnest(range(0, 365 + CASE WHEN jy % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 1 ELSE 0 END)) AS n FROM (SELECT unnest(range(1300, 1451)) AS jy))"""
_JDATE = f"SELECT cast(g AS date) AS g, jy, CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END AS jm, CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END AS jd, (dayofweek(g) + 1) % 7 + 1 AS weekday FROM ({_DIM})"
_TEXT = "concat(jy, '/', lpad(cast(jm AS varchar), 2, '0'), '/', lpad(cast(jd AS varchar), 2, '0'))"


@query(f"SELECT cast(o.o_orderkey AS bigint) AS o_orderkey, {_TEXT} AS jdate, j.jy, j.jm, j.jd, j.weekday FROM orders o LEFT JOIN ({_JDATE}) j ON cast(o.o_orderdate AS date) = j.g")
def gen_jalali_dim(d: Data):
    dim = G.jalali_dim(d.spark)
    return d.orders.select("o_orderkey", F.to_date("o_orderdate").alias("gdate")).join(F.broadcast(dim), "gdate", "left").drop("gdate")


@query(f"WITH j AS ({_JDATE}), s AS (SELECT l_orderkey, l_linenumber, cast(l_shipdate AS date) AS a, cast(o_orderdate AS date) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, concat('آیا ', x.jy, '/', lpad(cast(x.jm AS varchar), 2, '0'), '/', lpad(cast(x.jd AS varchar), 2, '0'), ' پیش از ', y.jy, '/', lpad(cast(y.jm AS varchar), 2, '0'), '/', lpad(cast(y.jd AS varchar), 2, '0'), ' است؟') AS question, CASE WHEN a < b THEN 'yes' ELSE 'no' END AS label FROM s LEFT JOIN j x ON s.a = x.g LEFT JOIN j y ON s.b = y.g")
def gen_jalali_compare(d: Data):
    pairs = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("a"), F.to_date("o_orderdate").alias("b"))
    return G.compare_dates(pairs, "a", "b", G.jalali_dim(d.spark)).select("l_orderkey", "l_linenumber", "question", "label")


@query(f"SELECT DISTINCT o_orderkey, {_TEXT} AS jdate, cast(weekday AS varchar) AS label FROM orders LEFT JOIN ({_JDATE}) ON cast(o_orderdate AS date) = g")
def gen_jalali_weekday(d: Data):
    return G.weekday_items(d.orders.select("o_orderkey", F.to_date("o_orderdate").alias("g")), "g", G.jalali_dim(d.spark)).select("o_orderkey", "jdate", "label")


@query("SELECT o_orderkey, translate(cast(a AS varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian, translate(cast(b AS varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic, a = b AS same FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS a, cast(floor(o_totalprice) AS bigint) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 10 END AS b FROM orders)")
def gen_digit_forms(d: Data):
    o = d.orders.select("o_orderkey", F.floor("o_totalprice").alias("a")).withColumn("b", F.col("a") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(10))
    return G.digit_forms(o, "a", "b").select("o_orderkey", "persian", "arabic", "same")


@query("SELECT o_orderkey, CASE WHEN r > 10 * t THEN 'yes' ELSE 'no' END AS more, CASE WHEN r > 10 * t THEN 'rial' WHEN r < 10 * t THEN 'toman' ELSE 'equal' END AS choice FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) * 10 AS r, cast(floor(o_totalprice) AS bigint) + o_orderkey % 3 - 1 AS t FROM orders)")
def gen_toman_rial(d: Data):
    o = d.orders.select("o_orderkey", (F.floor("o_totalprice") * 10).alias("r"), (F.floor("o_totalprice") + F.col("o_orderkey") % 3 - 1).alias("t"))
    return G.toman_rial(o, "r", "t").select("o_orderkey", "more", "choice")


@query("""SELECT id, day, m AS minute, CASE WHEN day < 6 AND m >= 540 AND m < 1020 OR day = 6 AND m >= 1200 OR day = 7 AND m < 120 THEN 'yes' ELSE 'no' END AS open FROM (SELECT event_id AS id, (dayofweek(ts) + 1) % 7 + 1 AS day, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def gen_business_hours(d: Data):
    hours = values(d, "day, from_min, to_min", *[(k, 540, 1020) for k in range(1, 6)], (6, 1200, 120))
    return G.business_hours(d.events.select(F.col("event_id").alias("id"), "ts"), "ts", hours)


@query("SELECT c_custkey, c_custkey % 4 < 3 AND c_custkey % 7 <> 0 AS valid FROM customer")
def gen_mobile_valid(d: Data):
    n = F.concat(F.lit("9"), F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0"))
    n = F.when(F.col("c_custkey") % 7 == 0, F.substring(n, 1, 9)).otherwise(n)
    n = F.when(F.col("c_custkey") % 2 == 0, TX.to_persian_digits(n)).otherwise(n)
    start = F.element_at(F.array(F.lit("0"), F.lit("+98"), F.lit("0098"), F.lit("00")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return d.customer.select("c_custkey", G.mobile_valid(F.concat(start, n)).alias("valid"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS valid FROM supplier")
def gen_postal_valid(d: Data):
    code = F.lpad((F.col("s_suppkey") * 104729 % 10000000000).cast("string"), 10, "1")
    code = F.when(F.col("s_suppkey") % 3 == 1, F.substring(code, 1, 9)).when(F.col("s_suppkey") % 3 == 2, F.concat(code, F.lit("-"))).otherwise(TX.to_persian_digits(code))
    return d.supplier.select("s_suppkey", G.postal_valid(code).alias("valid"))


@query("SELECT e.event_id, t.template_id, replace(replace(t.pattern, '{who}', cast(e.user_id AS varchar)), '{what}', e.event_type) AS question_text FROM events e JOIN fx_templates t ON e.event_type = t.task")
def template_expand(d: Data):
    facts = d.events.select("event_id", "user_id", "event_type", F.col("event_type").alias("task"))
    return G.template_expand(facts, d.fx_templates, {"who": "user_id", "what": "event_type"}).select("event_id", "template_id", "question_text")


_HOLD = "SELECT *, row_number() OVER (PARTITION BY task ORDER BY H32(concat('0:', template_id)), template_id) <= 2 AS held_out FROM fx_templates"


@query(f"SELECT task, template_id, held_out FROM ({_HOLD})")
def template_holdout(d: Data):
    return M.template_holdout(d.fx_templates).select("task", "template_id", "held_out")


_GEN = "SELECT 'toman' AS generator, concat('t', cast(o_orderkey AS varchar)) AS id FROM orders UNION ALL SELECT 'hours', concat('h', cast(event_id AS varchar)) FROM events"


@query(f"SELECT generator, id FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY H32(concat('1:', id)), id) AS r FROM ({_GEN})) WHERE r <= 2000")
def gen_mix(d: Data):
    one = d.orders.select(F.lit("toman").alias("generator"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("id"))
    return G.gen_mix([one, d.events.select(F.lit("hours").alias("generator"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"))], 4000, 1)


@query("SELECT 0::BIGINT AS only_a, count(*) AS only_b FROM fx_docs WHERE doc_id % 50 = 1")
def gen_reproduce(d: Data):
    a = d.fx_docs.select("id", "label")
    return G.gen_reproduce(a, a.unionByName(d.fx_docs.where("doc_id % 50 = 1").select(F.concat("id", F.lit("+")).alias("id"), "label")))


# translation checks


@query("SELECT page_id, trim(regexp_replace(translate(translate(url, 'يكىة', 'یکیه'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[ \\t]+', ' ', 'g')) AS url FROM pages")
def text_normalize(d: Data):
    return d.pages.select("page_id", TX.normalize(F.col("url")).alias("url"))


#: Phrases as people type them, and as they are spelled right, `|` for a zero-width non-joiner.
PERSIAN_TYPED = ("کتاب ها", "خانه های", "كتابهايش", "تنها", "بزرگ تر", "رفته ام", "شهر | ما", "میوهها"), ("می رود", "نمی خواهد", "می را خورد", "رفت", "می  گویند")
PERSIAN_RIGHT = ("کتاب|ها", "خانه|های", "کتاب|هایش", "تنها", "بزرگ|تر", "رفته|ام", "شهر ما", "میوه|ها"), ("می|رود", "نمی|خواهد", "می را خورد", "رفت", "می|گویند")


def _sentence(phrases: tuple[tuple[str, ...], ...], digits: str) -> str:
    """SQL of a sentence about an event: phrases by its id, its user and its value's whole part in digits of one kind."""
    pick = lambda ps, n: f"CASE {n} % {len(ps)} " + " ".join(f"WHEN {i} THEN '{p.replace('|', TX.ZWNJ)}'" for i, p in enumerate(ps)) + " END"
    number = f"translate(cast(cast(floor(value) AS bigint) AS string), '0123456789', '{digits}')"
    return f"concat({pick(phrases[0], 'event_id')}, ' ', {number}, ' ', {pick(phrases[1], 'user_id')})"


@query(f"SELECT event_id, {_sentence(PERSIAN_RIGHT, TX.LATIN)} AS text FROM events")
def zwnj_placed(d: Data):
    return d.events.select("event_id", TX.normalize(F.expr(_sentence(PERSIAN_TYPED, TX.PERSIAN))).alias("text"))


@query("SELECT source_id, field, source_text = target_text AS ok FROM fx_pairs WHERE rule = 'keep'")
def qa_keep_identical(d: Data):
    return Q.keep_identical(d.fx_pairs)


_NUMS = "list_sort(regexp_extract_all(regexp_replace(translate(coalesce({}, ''), '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '[0-9]+(?:\\.[0-9]+)?'))"


@query(f"SELECT source_id, field, {_NUMS.format('source_text')} = {_NUMS.format('target_text')} AS ok FROM fx_pairs")
def qa_numbers_survive(d: Data):
    return Q.numbers_survive(d.fx_pairs)


@query(r"SELECT source_id, field, coalesce(len(regexp_extract_all(target_text, '\p{Latin}'))::DOUBLE / nullif(len(regexp_extract_all(target_text, '\p{L}')), 0) >= 0.5, false) AS ok FROM fx_pairs WHERE rule = 'translate'")
def qa_language(d: Data):
    return Q.language_ok(d.fx_pairs, "Latin")


@query("SELECT source_id, field, round(length(target_text)::DOUBLE / nullif(length(source_text), 0), 6) AS ratio, coalesce(length(trim(target_text)) > 0 AND length(target_text)::DOUBLE / nullif(length(source_text), 0) BETWEEN 0.4 AND 2.5, false) AS ok FROM fx_pairs WHERE rule = 'translate'")
def qa_length_ratio(d: Data):
    return Q.length_ratio(d.fx_pairs)


@query(f"""WITH g AS (SELECT source_id, field, x FROM (SELECT source_id, field, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS x, lead(w, 2) OVER o AS z FROM ({_tokens('fx_pairs', 'source_id, field', 'target_text')}) WINDOW o AS (PARTITION BY source_id, field ORDER BY i)) WHERE z IS NOT NULL), c AS (SELECT source_id, field, x, count(*) AS n FROM g GROUP BY 1, 2, 3),
    s AS (SELECT source_id, field, sum(n) AS total, max(n) AS top FROM c GROUP BY 1, 2) SELECT p.source_id, p.field, coalesce(total, 0)::BIGINT AS total, coalesce(top, 0) AS top, NOT coalesce(top >= 4 AND top >= 0.3 * total, false) AS ok FROM fx_pairs p LEFT JOIN s ON p.source_id = s.source_id AND p.field = s.field""")
def qa_looping(d: Data):
    return Q.looping(d.fx_pairs)


@query(f"SELECT source_id, en_term, bool_and(contains(lower(coalesce(target_text, '')), fa_term)) AS ok FROM (SELECT DISTINCT row, source_id, target_text, en_term FROM ({_terms('(SELECT *, row_number() OVER () AS row FROM fx_pairs)', 'source_id, target_text', 'source_text')})) JOIN {_GLOSSARY} USING (en_term) GROUP BY 1, 2")
def qa_glossary_match(d: Data):
    return Q.glossary_match(d.fx_pairs, glossary(d))


@query("SELECT source_id, " + ", ".join(f"bool_or(flagged AND flag_kind = '{k}') AS {k}" for k in Q.FLAG_KINDS) + ", bool_or(flagged) AS meaning_flag FROM fx_verdicts GROUP BY 1")
def qa_meaning_flags(d: Data):
    return Q.meaning_flags(d.fx_pairs, d.fx_verdicts)


@query(f"""WITH f AS (SELECT source_id, 'keep' AS "check", bool_and(source_text = target_text) AS ok FROM fx_pairs WHERE rule = 'keep' GROUP BY 1 UNION ALL SELECT source_id, 'numbers', bool_and({_NUMS.format('source_text')} = {_NUMS.format('target_text')}) FROM fx_pairs GROUP BY 1)
    SELECT "check", count(*) AS cases, round(avg(ok::INT), 6) AS pass_rate FROM (SELECT * FROM f UNION ALL SELECT source_id, 'all', bool_and(ok) FROM f GROUP BY 1) GROUP BY 1""")
def qa_summary(d: Data):
    return Q.qa_summary({"keep": Q.keep_identical(d.fx_pairs), "numbers": Q.numbers_survive(d.fx_pairs)}).withColumn("pass_rate", F.round("pass_rate", 6))


_QUEUE = "SELECT source_id, 'flagged' AS reason FROM fx_flags WHERE flagged UNION ALL SELECT source_id, reason FROM (SELECT source_id, 'random' AS reason FROM fx_flags WHERE NOT flagged ORDER BY H32(concat('0:', source_id)), source_id LIMIT 125)"


@query(_QUEUE)
def review_queue(d: Data):
    return Q.review_queue(d.fx_flags)


_Z = "1.959963984540054"


@query(f"""SELECT n, errors, round(p, 6) AS rate, round((p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z}/(1 + {_Z}*{_Z}/n) * sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n)), 6) AS low, round((p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z}/(1 + {_Z}*{_Z}/n) * sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n)), 6) AS high
    FROM (SELECT count(*) AS n, sum((outcome <> 'ok')::INT)::BIGINT AS errors, avg((outcome <> 'ok')::INT) AS p FROM ({_QUEUE}) q JOIN fx_reviews r ON q.source_id = r.source_id WHERE reason = 'random')""")
def review_error_rate(d: Data):
    e = Q.review_error_rate(Q.review_queue(d.fx_flags), d.fx_reviews)
    return e.select("n", "errors", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("SELECT p.source_id, p.field, CASE WHEN r.outcome = 'fix' THEN r.fix_text ELSE p.target_text END AS target_text FROM fx_pairs p LEFT JOIN fx_reviews r ON p.source_id = r.source_id WHERE r.outcome IS DISTINCT FROM 'drop'")
def review_apply(d: Data):
    return Q.review_apply(d.fx_pairs, d.fx_reviews).select("source_id", "field", "target_text")


@query("SELECT sum((H32(concat('v', id)) % 3 = 0)::INT)::BIGINT AS first_wins, sum((H32(concat('v', id)) % 3 = 1)::INT)::BIGINT AS second_wins, sum((H32(concat('v', id)) % 3 = 2)::INT)::BIGINT AS ties FROM (SELECT cast(doc_id AS varchar) AS id FROM documents)")
def pilot_blind(d: Data):
    c = d.documents.select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("first"), F.upper("text").alias("second"))
    blind = Q.pilot_blind(c)
    want = h32(F.concat(F.lit("v"), "source_id")) % 3
    vote = F.when(want == 2, "tie").when((want == 0) == ~F.col("swapped"), "a").otherwise("b")
    return Q.pilot_tally(blind, blind.select("source_id", vote.alias("vote")))


@query("SELECT id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 17 = 1 THEN 'gold' ELSE 'split' END AS problem FROM fx_docs WHERE doc_id % 17 < 2 OR doc_id % 17 = 2 AND split <> 'test' UNION ALL SELECT concat(id, '+'), 'extra' FROM fx_docs WHERE doc_id % 17 = 3")
def release_parity(d: Data):
    f = d.fx_docs.select("id", "doc_id", "split", "label")
    k = F.col("doc_id") % 17
    t = f.where(k != 0).withColumn("label", F.when(k == 1, F.concat("label", F.lit("?"))).otherwise(F.col("label"))).withColumn("split", F.when(k == 2, "test").otherwise(F.col("split")))
    return Q.release_parity(f, t.unionByName(f.where(k == 3).withColumn("id", F.concat("id", F.lit("+")))))


@query("SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM (SELECT sum((flagged AND bad)::INT)::BIGINT AS tp, sum((flagged AND NOT bad)::INT)::BIGINT AS fp, sum((NOT flagged AND bad)::INT)::BIGINT AS fn, sum((NOT flagged AND NOT bad)::INT)::BIGINT AS tn FROM (SELECT f.flagged, r.outcome <> 'ok' AS bad FROM fx_flags f JOIN fx_reviews r ON f.source_id = r.source_id))")
def checker_agreement(d: Data):
    return Q.checker_agreement(d.fx_flags, d.fx_reviews)


# the training mix


@query("SELECT cast(c_custkey AS varchar) AS id, (SELECT string_agg(concat(k, '=', n), ';' ORDER BY k) FROM (SELECT cast(n_nationkey AS varchar) AS k, lower(n_name) AS n FROM nation)) AS opts, cast(c_nationkey AS varchar) AS best FROM customer")
def conv_intent(d: Data):
    desc = d.nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("text"))
    r = M.conv_intent(d.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_nationkey"), desc, "c_nationkey")
    best = F.element_at(F.map_keys(F.map_filter("gold", lambda k, v: v == 1.0)), 1)
    return shown(r.withColumn("best", best), "best").drop("golds")


@query("SELECT cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_partkey AS varchar) AS id, CASE l_returnflag WHEN 'A' THEN '1.0;0.0;0.0' WHEN 'N' THEN '0.0;1.0;0.0' ELSE '0.0;0.0;1.0' END AS three, CASE l_returnflag WHEN 'A' THEN '1.0;0.0' ELSE '0.0;1.0' END AS golds FROM lineitem")
def conv_entailment(d: Data):
    label = F.when(F.col("l_returnflag") == "A", "entailment").when(F.col("l_returnflag") == "N", "neutral").otherwise("contradiction")
    li = d.lineitem.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"), label.alias("label"))
    three = shown(M.conv_entailment(li, "label"), "label").select("id", "label", F.col("golds").alias("three"))
    return shown(M.conv_entailment(three, "label", True), "three").drop("opts")


@query("SELECT event_id AS id, CASE WHEN value > 20 THEN '1.0;0.0' ELSE '0.0;1.0' END AS golds FROM events")
def conv_answerable(d: Data):
    return shown(M.conv_answerable(d.events.select(F.col("event_id").alias("id"), (F.col("value") > 20).alias("f")), "f")).drop("opts")


@query("SELECT p_partkey AS id, concat('0=', p_brand, ';1=', p_type, ';2=', p_name) AS opts, ['1.0;0.0;0.0', '0.0;1.0;0.0', '0.0;0.0;1.0'][1 + p_size % 3] AS golds FROM part")
def conv_multichoice(d: Data):
    p = d.part.select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type", "p_name").alias("c"), (F.col("p_size") % 3).alias("a"))
    return shown(M.conv_multichoice(p, "c", "a"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '1.0;0.0' ELSE '0.0;1.0' END AS golds FROM orders")
def conv_paraphrase(d: Data):
    return shown(M.conv_paraphrase(d.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("s")), "s")).drop("opts")


@query("SELECT id, '1=1;2=2;3=3;4=4;5=5' AS opts, ['1.0;0.0;0.0;0.0;0.0', '0.0;1.0;0.0;0.0;0.0', '0.0;0.0;1.0;0.0;0.0', '0.0;0.0;0.0;1.0;0.0', '0.0;0.0;0.0;0.0;1.0'][gold] AS golds FROM fx_score")
def conv_sentiment(d: Data):
    return shown(M.conv_sentiment(d.fx_score.select("id", F.col("gold").alias("level")), "level"))


@query(r"SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+', '<email>', 'g'), '\+[0-9][0-9 ().-]{6,}[0-9]', '<phone>', 'g'), '[0-9]{6,}', '<number>', 'g') AS text, 'de=German;en=English;es=Spanish;fr=French' AS opts FROM documents")
def conv_transcript(d: Data):
    desc = values(d, "id, text", ("en", "English"), ("de", "German"), ("es", "Spanish"), ("fr", "French"))
    return shown(M.conv_transcript(d.documents.select(F.col("doc_id").alias("id"), "text", "lang"), "text", "lang", desc), "text").drop("golds")


_QA = "SELECT doc_id AS id, concat('q', cast(doc_id AS string)) AS question, text AS passage, substr(text, 20, 12) AS answer FROM documents"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY H32(concat('0:', cast(id AS varchar))), id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT *, H32(concat('g:0:', cast(id AS varchar))) % greatest(1, (SELECT count(*) FROM documents) // 1024) AS grp FROM ({_QA})))
    SELECT a.id, a.question, b.id AS from_id, b.passage FROM r a JOIN r b ON a.grp = b.grp AND b.r = (a.r + 1) % a.n WHERE a.id <> b.id AND NOT contains(b.passage, a.answer)""")
def neg_wrong_passage(d: Data):
    return M.neg_wrong_passage(d.sql(_QA))


@query("SELECT id, CASE WHEN p > 0 THEN substr(passage, greatest(1, least(p - (200 - length(answer)) // 2, length(passage) - 199))::BIGINT, 200) ELSE substr(passage, 1, 200) END AS passage FROM (SELECT *, strpos(passage, answer) AS p FROM (SELECT doc_id AS id, text AS passage, substr(text, length(text) // 2, 12) AS answer FROM documents))")
def truncate_keep_answer(d: Data):
    q = d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("passage"), F.expr("substr(text, length(text) div 2, 12)").alias("answer"))
    return q.select("id", M.truncate_keep_answer(F.col("passage"), F.col("answer"), 200).alias("passage"))


@query(f"WITH t AS (SELECT task, list(template_id ORDER BY template_id) AS l FROM ({_HOLD}) WHERE NOT held_out GROUP BY 1) SELECT event_id AS id, l[1 + H32(concat('0:', cast(event_id AS varchar))) % len(l)] AS template_id FROM events LEFT JOIN t ON event_type = task")
def template_assign(d: Data):
    return M.template_assign(d.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("task")), M.template_holdout(d.fx_templates)).select("id", "template_id")


@query(f"SELECT id, CASE WHEN s THEN 'no=No;yes=Yes' ELSE 'yes=Yes;no=No' END AS opts, CASE WHEN (label = 'yes') <> s THEN '1.0;0.0' ELSE '0.0;1.0' END AS golds FROM (SELECT id, label, H32(concat('0:', id, ':no')) < H32(concat('0:', id, ':yes')) AS s FROM fx_docs)")
def opt_shuffle(d: Data):
    return shown(M.opt_shuffle(records(d)))


@query(f"SELECT id, CASE WHEN H32(concat('0:', id)) / 4294967296.0::DOUBLE < 0.3 THEN 'opt_1=Yes;opt_2=No' ELSE 'yes=Yes;no=No' END AS opts, {_GOLD} AS golds FROM fx_docs")
def opt_rename(d: Data):
    return shown(M.opt_rename(records(d)))


@query("""SELECT id, CASE WHEN NOT a THEN 'yes=Yes;no=No' WHEN NOT x THEN 'yes=Yes;no=No;none=None of these' WHEN label = 'yes' THEN 'no=No;none=None of these' ELSE 'yes=Yes;none=None of these' END AS opts, CASE WHEN NOT a AND label = 'yes' THEN '1.0;0.0' WHEN NOT a THEN '0.0;1.0' WHEN x THEN '0.0;1.0' WHEN label = 'yes' THEN '1.0;0.0;0.0' ELSE '0.0;1.0;0.0' END AS golds
    FROM (SELECT id, label, H32(concat('0:add:', id)) / 4294967296.0::DOUBLE < 0.2 AS a, H32(concat('0:drop:', id)) / 4294967296.0::DOUBLE < 0.5 AS x FROM fx_docs)""")
def opt_none_of_these(d: Data):
    return shown(M.opt_none_of_these(records(d)))


_LONG = "SELECT cast(c.c_custkey AS string) AS id, n.n_nationkey AS idx, cast(n.n_nationkey AS string) AS option_id, CASE WHEN n.n_nationkey = c.c_nationkey THEN cast(1 AS double) ELSE cast(0 AS double) END AS g FROM customer c CROSS JOIN nation n"
_RANK = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY g DESC, H32(concat('0:', id, ':', option_id)), idx) AS rk FROM ({_LONG})"


@query(f"SELECT id, option_id, g FROM ({_RANK}) WHERE rk <= 8")
def opt_sample_negatives(d: Data):
    return M.opt_sample_negatives(d.sql(_LONG)).select("id", "option_id", "g")


@query(f"SELECT id, option_id, g FROM ({_RANK}) WHERE rk <= 20")
def opt_cap(d: Data):
    return M.opt_cap(d.sql(_LONG)).select("id", "option_id", "g")


@query("""SELECT id, 'same' AS slice FROM fx_docs WHERE lang = 'en' UNION ALL SELECT concat(id, '-fa'), 'cross' FROM fx_docs WHERE lang = 'en'""")
def lang_slice(d: Data):
    r = records(d)
    other = r.where("state_lang = 'en'").withColumn("state_lang", F.lit("fa")).withColumn("question_lang", F.lit("fa")).withColumn("id", F.concat("id", F.lit("-fa")))
    both = r.where("state_lang = 'en'").unionByName(other)
    # both questions of a case have the type noul, so the question's task tells them apart
    both = both.withColumn("question_type", F.concat("question_type", F.substring_index("question_text", " ", -1)))
    return M.lang_slice(both).select("id", "slice")


@query(r"SELECT source, count(*) AS n, quantile_cont(k, 0.5)::DOUBLE AS p50, quantile_cont(k, 0.9)::DOUBLE AS p90, round(quantile_cont(k, 0.99), 6)::DOUBLE AS p99, max(k) AS longest FROM (SELECT source, len(regexp_extract_all(text, '\S+')) AS k FROM documents) GROUP BY 1")
def len_profile(d: Data):
    return M.len_profile(d.documents, "text", ["source"]).withColumn("p99", F.round("p99", 6))


@query(r"SELECT doc_id, n > 256 AS over, CASE WHEN n > 256 THEN array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 256), ' ') ELSE text END AS text FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM documents)")
def len_cap(d: Data):
    return M.len_cap(d.documents, "text", 256).select("doc_id", "over", "text")


_SHARES = "SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'big' ELSE event_type END AS s FROM events"


@query(f"""WITH e AS ({_SHARES}), c AS (SELECT s, count(*) AS n FROM e GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, s) - 1 AS j, coalesce(sum(n) OVER (ORDER BY n DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER () AS total FROM c),
    w AS (SELECT arg_min((total - above) / (1 - j * 0.3::DOUBLE), j) AS t FROM t WHERE 1 - j * 0.3 > 1e-9 AND n <= 0.3::DOUBLE * ((total - above) / (1 - j * 0.3::DOUBLE)))
    SELECT event_id FROM (SELECT e.event_id, e.s, row_number() OVER (PARTITION BY e.s ORDER BY H32(concat('0:', cast(event_id AS varchar))), event_id) AS r FROM e) x WHERE r <= (SELECT floor(0.3::DOUBLE * t) FROM w)""")
def mix_cap_share(d: Data):
    return M.mix_cap_share(d.sql(_SHARES), source="s", id_col="event_id").select("event_id")


@query("SELECT doc_id, unnest(range(1, 1 + cast(ceil(60.0 / n) AS bigint))) AS copy FROM (SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def mix_upsample(d: Data):
    return M.mix_upsample(d.documents.select("doc_id", "source"), 60).select("doc_id", "copy")


_UNEVEN = "SELECT doc_id, CASE WHEN cast(substr(source, 4) AS int) < 12 THEN 'big' ELSE source END AS source FROM documents"


@query(f"""WITH e AS ({_UNEVEN}), b AS (SELECT count(*) // 15 AS floor, count(*) * 7 // 10 AS most FROM e), n AS (SELECT source, count(*) AS n, greatest(count(*), any_value(floor)) AS w FROM e CROSS JOIN b GROUP BY 1),
    l AS (SELECT c, sum(least(w, c)) AS whole FROM n CROSS JOIN range(1, (SELECT max(w) + 1 FROM n)) r(c) GROUP BY 1), t AS (SELECT source, n, least(w, (SELECT max(c) FROM l, b WHERE c <= 0.3 * whole + 1e-9 AND whole <= most)) AS target FROM n),
    x AS (SELECT e.doc_id, t.target // t.n + CASE WHEN row_number() OVER (PARTITION BY e.source ORDER BY H32(concat('0:', cast(e.doc_id AS varchar))), e.doc_id) <= t.target % t.n THEN 1 ELSE 0 END AS times FROM e JOIN t ON e.source = t.source)
    SELECT doc_id, unnest(range(1, cast(times AS bigint) + 1)) AS copy FROM x""")
def mix_balance(d: Data):
    """A mix of 70 % of the documents: no source above 30 %, none below a fifteenth of the documents."""
    n = d.documents.count()
    return M.mix_balance(d.sql(_UNEVEN), 0.3, n // 15, 0, n * 7 // 10, id_col="doc_id").select("doc_id", "copy")


@query("SELECT id FROM fx_docs WHERE origin <> 'translated'")
def mix_ablate(d: Data):
    return M.mix_ablate(records(d), "translated").select("id")


@query("SELECT source, n, round(n::DOUBLE / total, 6) AS share, n <= 0.3 * total AS share_ok, total, total BETWEEN 30000 AND 60000 AS total_ok FROM (SELECT source, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM fx_docs GROUP BY 1)")
def mix_size_gate(d: Data):
    return M.mix_size_gate(records(d)).withColumn("share", F.round("share", 6))


@query("SELECT id, i AS idx, concat(text, chr(10), 'Is it ', task, '?', chr(10), CASE WHEN i = 0 THEN 'Yes' ELSE 'No' END) AS input, CASE WHEN (label = 'yes') = (i = 0) THEN 1.0::DOUBLE ELSE 0 END AS g FROM fx_docs CROSS JOIN (SELECT unnest(range(2)) AS i)")
def fmt_encoder(d: Data):
    return M.fmt_encoder(records(d))


@query("SELECT id, concat(text, chr(10), 'Is it ', task, '?', chr(10), 'A) Yes', chr(10), 'B) No', chr(10), 'Answer:') AS prompt, CASE WHEN label = 'yes' THEN 'A' ELSE 'B' END AS answer FROM fx_docs")
def fmt_decoder(d: Data):
    return M.fmt_decoder(records(d))


@query(r"""WITH g AS (SELECT *, lower(n_name) AS w FROM nation), r AS (SELECT *, H32(concat('g:0:', cast(p_partkey AS varchar))) % greatest(1, (SELECT count(*) FROM part) // 1024) AS grp FROM part),
    x AS (SELECT p_partkey, p_brand, p_type, coalesce(lead(p_brand) OVER o, first_value(p_brand) OVER o) AS t FROM r WINDOW o AS (PARTITION BY grp ORDER BY H32(concat('0:', cast(p_partkey AS varchar))), p_partkey))
    SELECT p_partkey AS id, concat('0=', p_brand, ';1=', p_type, CASE WHEN t IN (p_brand, p_type) THEN '' ELSE concat(';distractor=', t) END) AS opts, concat('1.0;0.0', CASE WHEN t IN (p_brand, p_type) THEN '' ELSE ';0.0' END) AS golds FROM x""")
def pert_distractor(d: Data):
    from tarazu.operators.compare import pert_distractor as more

    p = d.part.select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("c"), F.lit(0).alias("a"))
    return shown(more(M.conv_multichoice(p, "c", "a")))
