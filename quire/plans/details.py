"""Queries over what the main ones leave out: summaries, page scans, provider reductions, stores and further modes of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import validate as V
from quire.operators import extract as E
from quire.operators import feedback, images, mining, monitor, report, resume
from quire.plans import jobs
from quire.plans.queries import _CORRECTIONS, _FOUND, _MONITORED, _PIXELS, _RATES, FORM_TEXT, ID_TEXT, _corrections, _ID_SQL, _outcomes, _pairs, _rates, _squares, joined, query, read, scratch
from quire.sources import providers, readers, sheets, sinks

# --- validation and extraction ---


@query("SELECT o_orderkey, o_orderkey % 97 = 0 AS valid, CAST(o_orderkey AS VARCHAR) AS normalized FROM orders")
def validate_modulus(spark, sf_dir):
    v = V.Checksum(lambda d: V.modulus(d, 97), "modulus").check(F.concat(F.lit(" no. "), F.col("o_orderkey").cast("string")))
    return read(spark, sf_dir, "orders").withColumn("v", v).select("o_orderkey", "v.valid", "v.normalized")


@query("""WITH c AS (SELECT c_custkey, trim(c_mktsegment) AS s FROM customer) SELECT c_custkey, regexp_matches(s, '^B') OR length(s) BETWEEN 9 AND 9 AS valid,
concat_ws('|', CASE WHEN NOT regexp_matches(s, '^B') THEN 'does not match b' END, CASE WHEN length(s) <> 9 THEN concat('length ', length(s), ' outside [9, 9]') END) AS errors FROM c""")
def validate_any(spark, sf_dir):
    rule = V.Composite([V.Regex("B.*", "b"), V.Length(9, 9)], require_all=False)
    return read(spark, sf_dir, "customer").withColumn("v", rule.check(F.col("c_mktsegment"))).select("c_custkey", "v.valid", joined(F.col("v.errors")).alias("errors"))


@query("SELECT c_custkey, c_acctbal > 0 AS success, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS own FROM customer")
def validate_overlaid(spark, sf_dir):
    """An external outcome stands in place of the extractor's own, where there is one."""
    outcome = lambda ok, text: F.struct(ok.alias("valid"), F.lit(text).alias("value"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("normalized"))
    c = read(spark, sf_dir, "customer")
    external = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("x"), outcome(F.col("c_acctbal") > 0, "b")))
    v = V.overlaid(F.create_map(F.lit("x"), outcome(F.col("c_acctbal") > 0, "a")), external)
    return c.withColumn("v", v).select("c_custkey", V.succeeded(F.col("v")).alias("success"), F.element_at("v", F.lit("x"))["value"].alias("own"))


@query("SELECT s_suppkey, concat('PLT-', right(concat('0000', s_suppkey), 4)) AS plate, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('N', s_suppkey) END AS owner, s_suppkey % 4 <> 0 AS success FROM supplier")
def extract_plate(spark, sf_dir):
    text = F.concat(F.lit("PLT-"), F.right(F.concat(F.lit("0000"), F.col("s_suppkey").cast("string")), F.lit(4)), F.when(F.col("s_suppkey") % 4 == 0, F.lit("\n")).otherwise(F.concat(F.lit("\nowner: first\n OWNER : N"), F.col("s_suppkey").cast("string"))))
    done = E.PLATE.process(read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")))
    return done.select("s_suppkey", F.element_at("fields", F.lit("plate")).alias("plate"), F.element_at("fields", F.lit("owner")).alias("owner"), "success")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'yes' ELSE 'no' END AS folded, CASE WHEN o_orderkey % 3 = 0 THEN 'no' ELSE 'yes' END AS plain FROM (SELECT o_orderkey, {FORM_TEXT} AS text FROM orders)")
def signature_present(spark, sf_dir):
    """Only the marker's lower-case form is taken out, unless case is folded: a capital one then counts as what follows."""
    forms = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(FORM_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    return forms.select("o_orderkey", E.signature(True)(F.col("text")).alias("folded"), E.signature()(F.col("text")).alias("plain"))


# --- jobs ---


@query(f"WITH x AS ({_ID_SQL}) SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, 0 AS skipped, count(*) AS again_skipped, 4 AS batches FROM x")
def resumable_run(spark, sf_dir):
    """A job in batches with a context that passes from one to the next; run again, it skips all."""
    folder = f"{scratch(spark)}/job-{uuid.uuid4().hex}"
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("seq"), F.expr(ID_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    count = jobs.Step("count", lambda results, context: (results, context | {"batches": context.get("batches", 0) + 1}), with_context=True)
    first, again = (jobs.run_resumable(items, E.ID_CARD, f"{folder}/results", f"{folder}/done", 4, [count]) for _ in range(2))
    row = (first["total"], first["succeeded"], first["failed"], first["skipped"], again["skipped"], first["context"]["batches"])
    return spark.createDataFrame([row], "total long, succeeded long, failed long, skipped int, again_skipped long, batches int")


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) ORDER BY 1 LIMIT 50")
def resume_retry(spark, sf_dir):
    """Failed documents are tried again; the first fifty in order."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("seq"))
    done = orders.filter("seq % 3 = 0").select("document_id", (F.col("seq") % 2 == 0).alias("success"))
    return resume.pending(orders, done, limit=50, retry_failed=True).select("document_id")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS document_id FROM lineitem")
def done_list(spark, sf_dir):
    """Ids written as a list and read again."""
    path = f"{scratch(spark)}/done-{uuid.uuid4().hex}"
    resume.checkpoint(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))).write.text(path)
    return readers.done_ids(spark, path)


# --- pages and providers ---

_LAYERS = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(' ', chr(10)) ELSE text END AS layer, (conv_id * 31 + turn * 7) % 101 / 101.0::DOUBLE AS c, text FROM conversations WHERE turn <= 4"


def _layers(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    layer = F.when(F.col("turn") % 3 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("n"), layer.alias("layer"), "text")


@query(f"SELECT conv_id AS path, turn AS n, length(CASE WHEN turn % 3 = 0 THEN text ELSE layer END) AS chars, CASE WHEN turn % 3 = 0 THEN 'fast' ELSE 'textlayer' END AS provider, CASE WHEN turn % 3 = 0 THEN round(c, 3) ELSE 1.0::DOUBLE END AS conf FROM ({_LAYERS})")
def page_scan(spark, sf_dir):
    read_by = providers.Expression("fast", F.col("text"), (F.col("path") * 31 + F.col("n") * 7) % 101 / 101.0)
    return report.scanned(_layers(spark, sf_dir), read_by, max_pages=4).select("path", "n", "chars", "provider", "conf")


@query(f"SELECT conv_id AS path, turn AS n, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(layer) END AS chars, CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'textlayer' END AS provider, CASE WHEN turn % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM ({_LAYERS})")
def page_scan_text_only(spark, sf_dir):
    return report.scanned(_layers(spark, sf_dir).drop("text"), max_pages=4).select("path", "n", "chars", "provider", "conf")


@query("SELECT o_orderkey, round(coalesce(avg(l_discount), 0), 6) AS confidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 3 <> 0 GROUP BY 1")
def word_confidence(spark, sf_dir):
    """Words of two blocks a page, a page for each return flag."""
    words = read(spark, sf_dir, "lineitem").filter("l_linenumber % 3 <> 0")
    by_block = words.groupBy("l_orderkey", "l_returnflag", (F.col("l_linenumber") % 2).alias("b")).agg(F.collect_list(F.struct(F.col("l_discount").alias("confidence"))).alias("words"))
    blocks = by_block.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.array(F.struct("words")).alias("paragraphs"))).alias("blocks"))
    pages = blocks.groupBy("l_orderkey").agg(F.collect_list(F.struct("blocks")).alias("pages"))
    orders = read(spark, sf_dir, "orders").join(pages, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return orders.select("o_orderkey", F.round(providers.word_confidence(F.col("pages")), 6).alias("confidence"))


@query("SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn), concat(' ', chr(10), chr(9), chr(13))) AS text, round(avg((conv_id + turn) % 7 / 7.0::DOUBLE), 6) AS confidence, 'surya' AS provider FROM conversations GROUP BY 1")
def lines_reading(spark, sf_dir):
    line = F.struct("turn", "text", ((F.col("conv_id") + F.col("turn")) % 7 / 7.0).alias("confidence"))
    pages = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return pages.withColumn("r", providers.lines_reading(F.col("lines"), "surya")).select("conv_id", "r.text", F.round("r.confidence", 6).alias("confidence"), "r.provider")


@query("SELECT concat('p', conv_id % 3) AS provider, count(*) AS docs, sum(turn)::DOUBLE AS seconds, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def provider_benchmark(spark, sf_dir):
    runs = read(spark, sf_dir, "conversations").select(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("provider"), F.col("turn").cast("double").alias("seconds"), "text")
    return report.provider_benchmark(runs)


# --- monitor ---


@query(_MONITORED.replace("@", "1") + """ SELECT history, round(window_full, 1) AS window_full, round(window_partial, 1) AS window_partial, round(window_none, 1) AS window_none, round(global_full, 1) AS global_full,
concat_ws('|', CASE WHEN alert_drop THEN 'drop' END, CASE WHEN alert_critical THEN 'critical' END, CASE WHEN alert_streak THEN 'streak' END, CASE WHEN alert_very_low THEN 'very_low' END, CASE WHEN alert_improvement THEN 'improvement' END) AS alerts FROM a ORDER BY ts DESC, event_id DESC LIMIT 1""")
def monitor_summary(spark, sf_dir):
    order = ["ts", "event_id"]
    return monitor.summary(monitor.monitored(_outcomes(spark, sf_dir), order), order).withColumn("alerts", joined(F.col("alerts")))


# --- mining and feedback ---


@query(f"""{_FOUND}, q AS (SELECT field, count(*) AS n FROM f WHERE kind = 'confusion' GROUP BY 1), a AS (SELECT field, kind, count(*) AS n FROM f WHERE kind IN ('prefix', 'suffix') GROUP BY 1, 2), s AS (SELECT field, sum(least(n, 3))::BIGINT AS n FROM a GROUP BY 1),
c AS (SELECT o_orderpriority AS field, count(*) FILTER (o_orderkey % 13 < m) AS correct, count(*) AS every FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) * 3 - 1 AS m FROM orders) GROUP BY 1)
SELECT c.field, coalesce(s.n, 0) AS correction_rules, least(coalesce(q.n, 0), 10) AS patterns, round(correct / every::DOUBLE * 100.0, 1) AS success_rate FROM c LEFT JOIN s ON c.field = s.field LEFT JOIN q ON c.field = q.field""")
def learning_summary(spark, sf_dir):
    found, rates = mining.patterns(_pairs(spark, sf_dir)), _rates(spark, sf_dir)
    config = mining.rules(found).select("field", F.col("rules").alias("correction_rules"))
    return mining.learning_summary(config, found, rates)


@query(f"{_RATES}, g AS (SELECT sum(correct) / (sum(correct) + sum(error))::DOUBLE * 100.0 AS r FROM c) SELECT r AS initial_success_rate, r AS current_success_rate, 12.5::DOUBLE AS kept FROM g")
def global_success_rate(spark, sf_dir):
    now = mining.global_rate(_rates(spark, sf_dir))
    later = mining.kept_rates(now, spark.createDataFrame([(12.5,)], "initial_success_rate double")).select(F.col("initial_success_rate").alias("kept"))
    return mining.kept_rates(now).join(F.broadcast(later))  # one row each


@query(f"""{_CORRECTIONS}, w AS (SELECT 'a' AS field FROM c WHERE ca <> ea UNION ALL SELECT 'b' FROM c WHERE cb <> eb) SELECT field, count(*) AS errors, 1 - count(*) / (SELECT count(*) FROM c)::DOUBLE AS "precision" FROM w GROUP BY 1""")
def correction_precision(spark, sf_dir):
    return feedback.current_precision(_corrections(spark, sf_dir))


@query(f"{_CORRECTIONS} SELECT count(*) AS total_corrections, count(*) FILTER (NOT (ca <> ea AND cb <> eb)) AS fully_corrected FROM c")
def running_corrections(spark, sf_dir):
    return feedback.running(_corrections(spark, sf_dir))


@query(f"""{_CORRECTIONS}, w AS (SELECT 'a' AS field, substr(CASE WHEN da = '' THEN 'N/A' ELSE da END, 1, 10) AS d, substr(ca, 1, 10) AS k FROM c WHERE ca <> ea UNION ALL SELECT 'b', substr(db, 1, 10), substr(cb, 1, 10) FROM c WHERE cb <> eb),
s AS (SELECT field, count(*) AS n FROM w GROUP BY field, d, k HAVING count(*) >= 2), f AS (SELECT unnest(['a', 'b', 'never']) AS field) SELECT f.field, least(count(s.n), 5) AS n_rules FROM f LEFT JOIN s ON f.field = s.field GROUP BY 1""")
def model_status(spark, sf_dir):
    return feedback.model_status(feedback.promoted(_corrections(spark, sf_dir)), ["a", "b", "never"])


_PATHS = "concat('/refs/', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '/correct/' WHEN o_orderkey % 11 = 0 THEN '/other/' ELSE '/error/' END, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('_detected_', o_custkey) ELSE '' END, '_7', CASE WHEN o_orderkey % 5 = 0 THEN '.jpg' WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.png' END)"


@query(f"""WITH p AS (SELECT *, {_PATHS} AS path FROM orders) SELECT split_part(path, '/', 3) AS field, split_part(path, '/', 4) AS outcome, split_part(path, '/', 5) AS filename,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS expected, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS detected FROM p WHERE split_part(path, '/', 4) <> 'other' AND NOT ends_with(path, '.txt')""")
def reference_paths(spark, sf_dir):
    return mining.references(read(spark, sf_dir, "orders").select(F.expr(_PATHS).alias("path")))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 10 = o_custkey % 10 AS matches FROM orders")
def reference_name_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.lit("scan.png")).otherwise(F.concat((k % 10).cast("string"), F.lit("_1.png")))
    return read(spark, sf_dir, "orders").select("o_orderkey", feedback.matches_expected((F.col("o_custkey") % 10).cast("string"), name).alias("matches"))


@query("""WITH x AS (SELECT vec_id, concat('f', label % 3) AS field, CASE WHEN vec_id % 2 = 0 THEN 'correct' ELSE 'error' END AS outcome, concat(vec_id, '_1.png') AS filename FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY field, outcome ORDER BY filename) AS k FROM x), """ + _PIXELS.removeprefix("WITH ") + """, s AS (SELECT vec_id, avg(v) AS b, stddev_pop(v) AS c FROM p GROUP BY 1)
SELECT field, outcome, round(avg(b), 6) AS brightness, round(avg(c), 6) AS contrast FROM n JOIN s ON n.vec_id = s.vec_id WHERE k <= 50 GROUP BY 1, 2""")
def field_features(spark, sf_dir):
    label = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("f"), (F.col("label") % 3).cast("string")).alias("field"))
    files = _squares(spark, sf_dir).join(label, "vec_id").select("field", F.when(F.col("vec_id") % 2 == 0, "correct").otherwise("error").alias("outcome"), F.concat(F.col("vec_id").cast("string"), F.lit("_1.png")).alias("filename"), "image")
    found = images.field_features(files)
    return found.select("field", "outcome", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))


# --- stores ---


@query("WITH n AS (SELECT CAST(i AS INT) AS row_number FROM generate_series(1, (SELECT max(c_custkey) + 5 FROM customer)) g(i)) SELECT row_number, CASE WHEN row_number % 4 = 1 THEN concat('new', row_number) WHEN c_custkey IS NOT NULL THEN c_name END AS name, c_mktsegment AS segment FROM n LEFT JOIN customer ON c_custkey = row_number")
def named_upsert(spark, sf_dir):
    """Records by number; updates beyond the last let the sheet grow."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("row_number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    most = rows.agg(F.max("row_number")).first()[0]
    updates = spark.range(1, most + 6).select(F.col("id").cast("int").alias("row_number")).select("row_number", F.when(F.col("row_number") % 4 == 1, F.concat(F.lit("new"), F.col("row_number").cast("string"))).alias("name"))
    return sinks.upsert_named(rows, updates)


@query("SELECT concat('q/', o_orderkey) AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'queued' WHEN o_orderkey % 3 = 1 THEN 'processed' ELSE 'failed' END AS status FROM orders")
def queue_moves(spark, sf_dir):
    queue = read(spark, sf_dir, "orders").select(F.concat(F.lit("q/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey")
    outcomes = queue.filter("o_orderkey % 3 <> 0").select("path", (F.col("o_orderkey") % 3 == 1).alias("success"))
    return sinks.moved(queue.select("path"), outcomes)


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, l_orderkey % 5 AS n FROM lineitem")
def written_twice(spark, sf_dir):
    """Documents that a crash let be written twice are read once."""
    folder = f"{scratch(spark)}/batch-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_orderkey") % 5).alias("n")).distinct()
    for _ in range(2):
        sinks.write_batch(docs, f"{folder}/docs", f"{folder}/done")
    return sinks.deduplicated(spark.read.schema("path string, n long").json(f"{folder}/docs"))


@query("SELECT CAST(s_suppkey + 1 AS INT) AS row_number, CASE WHEN s_suppkey % 3 = 0 THEN concat('a,\"', s_suppkey, '\"') ELSE s_name END AS a, CASE WHEN s_suppkey % 2 = 1 THEN 'done' ELSE '' END AS b FROM supplier")
def csv_backend(spark, sf_dir):
    """A CSV sheet that is filled and then updated, commas and quotes in its cells."""
    sheet = sheets.CsvSheet(spark, f"{scratch(spark)}/sheet-{uuid.uuid4().hex}")
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("row_number"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('a,"'), F.col("s_suppkey").cast("string"), F.lit('"'))).otherwise(F.col("s_name")).alias("value"))
    sheet.update(rows.select("row_number", F.lit("A").alias("letter"), "value"))
    sheet.update(rows.filter("row_number % 2 = 0").select("row_number", F.lit("B").alias("letter"), F.lit("done").alias("value")))
    return sheet.rows().select("row_number", readers.cell(F.col("cells"), "A").alias("a"), readers.cell(F.col("cells"), "B").alias("b"))


@query("SELECT CAST(s_suppkey + 1 AS INT) AS row_number, s_name AS a, CASE WHEN s_suppkey % 2 = 1 THEN 'done' ELSE '' END AS b FROM supplier")
def json_backend(spark, sf_dir):
    sheet = sheets.JsonSheet(spark, f"{scratch(spark)}/sheet-{uuid.uuid4().hex}", ["name", "status"])
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("row_number"), F.col("s_name").alias("value"))
    sheet.update(rows.select("row_number", F.lit("A").alias("letter"), "value"))
    sheet.update(rows.filter("row_number % 2 = 0").select("row_number", F.lit("B").alias("letter"), F.lit("done").alias("value")))
    return sheet.rows().select("row_number", readers.cell(F.col("cells"), "A").alias("a"), readers.cell(F.col("cells"), "B").alias("b"))


@query("SELECT doc_id, length(trim(text, concat(' ', chr(10), chr(9), chr(13), chr(11), chr(12)))) = 0 AS blank FROM documents")
def blank_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.is_blank(F.col("text")).alias("blank"))
