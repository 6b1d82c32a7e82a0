"""Readers, sinks, kernels, jobs and providers: expectations of the survey's fixtures, and brute force in Python and numpy."""

import csv
import difflib
import json
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

import quire.plans.details  # noqa: F401  registers its queries
from quire.functions import text as T
from quire.functions.ranges import at_or_below, quantiles
from quire.operators import cascade, extract, feedback, images, mining, monitor, report, similar
from quire.plans import jobs, queries
from quire.sources import providers, readers, sheets, sinks
from quire.streaming import monitor as streaming

# --- extractors ---


def processed(spark, extractor, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r for r in extractor.process(df).orderBy("i").collect()]


def test_a_form_without_a_signature_succeeds(spark):
    found = processed(spark, extract.FORM, ["Form FORM-ABC123", "FORM-ABC123\nSignature:", "FORM-ABC123 signature: \n", "signature: ABCDEF"])
    assert [(r.fields["form_code"], r.fields["signature_present"], r.success) for r in found] == [("FORM-ABC123", "no", True), ("FORM-ABC123", "yes", True), ("FORM-ABC123", "no", True), ("", "yes", False)]
    assert found[3].validation["form_code"].errors == ["does not match form code"]


def test_cards_and_invoices(spark):
    good = "REPUBLIC OF TESTLAND\nNATIONAL IDENTIFICATION CARD\nID Number: ID-12345678\nFull Name: TEST USER 42\n"
    a, b, c = processed(spark, extract.ID_CARD, [good, "ID Number: ID-1234567A\nFull Name: TEST USER 42\n", ""])
    assert a.success and a.fields["full_name"] == "REPUBLIC OF TESTLAND NATIONAL IDENTIFICATION CARD Full Name: TEST USER 42"
    assert not b.success and b.fields["id_number"] == "" and b.validation["id_number"].errors == ["does not match ID card number"] and not c.success
    a, b = processed(spark, extract.INVOICE, ["INV-2026-0042\nVendor: X\nTotal: $1,190.00", "Subtotal: $10.00"])
    assert a.fields["total_amount"] == "1" and a.success
    assert b.fields["total_amount"] == "" and b.validation["total_amount"].errors == ["does not match amount"]


def test_hooks_see_the_results(spark):
    seen = []
    hooked = extract.Extractor("id_card", extract.ID_CARD.fields, extract.ID_CARD.checks, hooks=[lambda df: seen.append(df.columns) or df])
    assert len(processed(spark, hooked, ["x"])) == 1 and "matches" in seen[0]


def test_plates_of_long_keys_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 7, 9_999, 10_001, 12_344, 60_000, 123_456_789)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    df = queries.QUERIES["extract_plate"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    found = con.execute(queries.SQL["extract_plate"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


# --- similarity ---


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def strings(seed, n, least=0):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abé1"), r.integers(least, 7))) for _ in range(n)]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_all_pairs_within_a_distance_are_found_once(spark, distance):
    a, b = strings(1, 60) + ["", None], strings(2, 90) + ["a", "", None]
    left, right = spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string")
    brute = sorted((x, y, d) for x in {*a} - {None} for y in {*b} - {None} if (d := edits(x, y)) <= distance)
    assert sorted(map(tuple, similar.pairs(left, right, "l", "r", distance).collect())) == brute


def test_tasks_of_pairs_follow_the_variants_and_no_side_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similar, "KEYS_A_TASK", 500)
    numbers = lambda n, step: spark.range(n).select((F.col("id") * step + 100_000).cast("string").alias("n"))
    found = similar.pairs(numbers(100, 7).withColumnRenamed("n", "l"), numbers(400, 11), "l", "n")
    assert found.rdd.getNumPartitions() == 22 * 500 // 500  # six digits have 1 + 6 + 15 variants at most
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("Broadcast" in line for line in joins)
    assert similar.similar_references(spark.createDataFrame([("100000",)], "target string"), numbers(400, 11).select(F.col("n").alias("number"), F.array(F.lit("x")).alias("paths"), F.lit(1).alias("seq"))).count() == 5


@pytest.mark.parametrize("k", [1, 3, 5])
def test_most_similar_references_with_numbers_in_many(spark, k):
    targets, numbers = sorted({*strings(3, 25, 2)}), strings(4, 150, 2)
    index = [(x, [["a.png"], ["a.png", "MANUAL/b.png"], []][i % 3], i) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(index, "number string, paths array<string>, seq int")
    got = similar.similar_references(spark.createDataFrame([(t,) for t in targets], "target string"), df, k, similarity=1 - F.col("distance") / 10.0).collect()
    brute = []
    for t in targets:
        near = sorted((edits(t, x), not (manual := len(p) == 2), s, x, (p[1:] or p or [None])[0], "manual" if manual else "automatic") for x, p, s in index if edits(t, x) <= 2)[:k]
        brute += [(t, x, d, path, priority, i) for i, (d, _, _, x, path, priority) in enumerate(near, 1)]
    assert sorted((r.target, r.rank, r.number, r.distance, r.path, r.priority) for r in got) == sorted((t, i, x, d, p, q) for t, x, d, p, q, i in brute)


def test_references_are_chosen_before_the_index_is_met(spark):
    df = spark.createDataFrame([("100000", ["x"], 1)], "number string, paths array<string>, seq int")
    plan = similar.similar_references(df.select(F.col("number").alias("target")), df, similarity=F.lit(1.0))._jdf.queryExecution().optimizedPlan().toString()
    met = plan[plan.index("Join ") :]  # the last join and what leads to it
    assert any("Window [row_number()" in line and "[target#" in line for line in met.splitlines())


# --- numbers and text ---


NUMBERED = ["ñ11 1111 de", "Ñ111111.", "n 111111 10ñm", "ciñ11 87.85.52.247 11a", "a\n123\n456 b", "a 12\t34\f56\r7,8.", "x_123456 E0123456", "1 2\u00a03 4 5 6 7", "1 23\x0b45 67 8", "\u0663123456\u0663", "e00 123.456,7", "", None]


@pytest.mark.parametrize("name", ["extract_numbers", "minimum_slice"])
def test_letters_beyond_ascii_end_words_as_in_sql(spark, tmp_path, name):
    docs = [(16 + 35 * i, t) for i, t in enumerate(NUMBERED)]  # these ids have both readings
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_numbers_by_the_words_of_unicode(spark):
    df = spark.createDataFrame([("ñ111111",), ("ñ 111111",)], "text string")
    assert [r[0] for r in df.select(T.extract_numbers(F.col("text"))).collect()] == [[], ["111111"]]


def test_counts_are_rounded_as_binary_values(spark):
    some = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 999_949, 999_950, 1_000_000, 1_050_000, 1_250_000, 12_345_678_900]
    expected = [f"{n / 1e6:.1f} M" if n >= 1_000_000 else f"{n / 1e3:.1f} k" if n >= 1000 else str(n) for n in some]
    got = spark.createDataFrame([(n,) for n in some], "n long").select("n", T.human_count(F.col("n")).alias("x")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.n)] == expected


def test_ratio_is_that_of_difflib(spark):
    pairs = [("12345", "12354"), ("", ""), ("", "1"), ("abcabc", "cbacba"), ("12345", None), ("é語x", "x語é")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.similarity_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == (None if r.b is None else difflib.SequenceMatcher(None, r.a, r.b).ratio()) for r in got)


@pytest.mark.parametrize("bounds", [[], [5], [1, 3, 8, 8, 20], list(range(0, 3000, 3))])
def test_binary_search_in_bounds(spark, bounds):
    got = spark.range(-2, 40).select("id", at_or_below(F.col("id"), bounds).alias("n")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


def test_quantiles_follow_the_values(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 0, F.lit(1 << 62)).otherwise(F.col("id")).alias("v"))
    bounds = quantiles(df, F.col("v"), 10)
    assert len(bounds) == 9 and max(bounds) < 1000


# --- monitor ---


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_ranges_give_the_monitor_of_one_window(spark, parts):
    """Ranges of many, few and no records, records of one time, and a time that is missing."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i == 17 else int(rng.integers(0, 60)) if i < 150 else int(i), ["FULL", "PARTIAL", "NONE", "MANUAL"][int(rng.integers(0, 4))]) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, t long, category string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = monitor.monitored(df, ["t", "event_id"])
        one = monitor.monitored(df.withColumn("k", F.lit(1)), ["t", "event_id"], ["k"]).drop("k")
        assert got.columns == one.columns
        assert sorted(got.collect(), key=lambda r: r.event_id) == sorted(one.collect(), key=lambda r: r.event_id)
        assert monitor.monitored(df.limit(0), ["t", "event_id"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def outcomes(spark, seq):
    return spark.createDataFrame([(i, m, manual) for i, (m, manual) in enumerate(seq)], "seq long, matches array<boolean>, manual boolean").withColumn("category", monitor.category(F.col("matches"), F.col("manual")))


def test_outcome_sequences(spark):
    last = lambda seq: monitor.monitored(outcomes(spark, seq), ["seq"]).orderBy("seq").collect()[-1]
    full, none = ([True, True], False), ([False, False], False)
    r = last([full] * 20)
    assert r.window_full == 100 and r.global_full == 100
    r = last([full] * 15 + [none] * 10)
    assert (r.window_full, r.global_full) == (50, 60) and r.alert_streak and not (r.alert_drop or r.alert_critical or r.alert_very_low)
    assert last([([], False)]).category == "FULL"
    assert last([(None, True)] * 15).alert_very_low
    r = last([full, ([False, False], True)])
    assert r.window_full == 100


# --- images ---


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(3)
    tilted = np.where((np.add.outer(np.arange(60) * 1.0, np.arange(80) * 0.12) // 6) % 2 == 0, 20.0, 230.0)
    flat, noisy = np.full((40, 30), 200.0), rng.integers(0, 256, (30, 45)).astype(float)
    pictures = {"tilted": tilted, "flat": flat, "noisy": noisy}
    rows = [(k, {"h": x.shape[0], "w": x.shape[1], "data": x.ravel().tolist()}) for k, x in pictures.items()] + [("broken", None), ("short", {"h": 3, "w": 3, "data": [1.0]})]
    df = spark.createDataFrame(rows, "name string, image struct<h:int,w:int,data:array<double>>")
    got = {(r.name, r.variant): np.array(r.image.data).reshape(r.image.h, r.image.w) for r in images.variants(df).collect()}
    assert {k for k, _ in got} == set(pictures)
    for name, x in pictures.items():
        assert got[name, "clean"].shape == (2 * x.shape[0], 2 * x.shape[1]) and got[name, "clean"].min() >= 0 and got[name, "clean"].max() <= 255
        p = np.pad(x, 1, mode="edge")
        assert np.array_equal(got[name, "denoise"], [[np.median(p[r : r + 3, c : c + 3]) for c in range(x.shape[1])] for r in range(x.shape[0])])
        gray = x / 255  # the threshold as it is defined over 0 to 1, with half the range of -1 to 1
        q = np.pad(gray, 12, mode="reflect")
        limit = [[(w := q[r : r + 25, c : c + 25]).mean() * (1 + 0.2 * (w.std() / 1.0 - 1)) for c in range(x.shape[1])] for r in range(x.shape[0])]
        away = np.abs(gray - limit) > 1e-9
        assert np.array_equal(got[name, "sauvola"][away], np.where(gray > limit, 255.0, 0.0)[away])
    assert (got["flat", "clean"] == 200).all() and images.clean(np.zeros((10, 1200))).shape == (10, 1200)
    assert abs(images.skew(tilted)) in (6, 7, 8)  # lines that fall by 0.12 a pixel


def test_an_upright_image_has_no_deskewed_variant(spark, monkeypatch):
    monkeypatch.setattr(images, "skew", lambda x: 0)
    assert images.deskew(np.ones((5, 5))) is None
    spot = np.zeros((9, 9))
    spot[2, 4] = 100
    turned = images.rotate(spot, 90)
    assert np.unravel_index(turned.argmax(), turned.shape) == (4, 2)  # counter-clockwise: what was above is left
    assert images.rotate(np.full((6, 6), 9.0), 45)[0, 0] == 0  # black outside


def test_resampling_keeps_what_it_should():
    x = np.arange(48, dtype=float).reshape(6, 8)
    assert np.array_equal(images.resize(x, 6, 8), x)
    assert np.array_equal(images.resize(np.full((7, 5), 99.0), 3, 11, "lanczos"), np.full((3, 11), 99.0))
    halves = images.resize(np.tile([0.0, 0.0, 100.0, 100.0], (4, 2)), 4, 4)
    assert halves.shape == (4, 4) and (halves[:, 0] < halves[:, 1]).all()
    # a triangle of twice the width over four pixels: weights 1 3 3 1 inside
    row = np.array([[10.0, 20, 40, 80, 160, 0, 0, 0]])
    assert images.resize(row, 1, 4)[0, 1] == np.floor((20 + 3 * 40 + 3 * 80 + 160) / 8 + 0.5)


def test_similarity_of_resized_images():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (150, 300)).astype(float)
    assert images.similarity(a, a) == pytest.approx(1.0)
    b = images.resize(a, 120, 260)
    x, y = images.resize(a, 100, 200), images.resize(b, 100, 200)
    h = [np.histogram(z, 64, (0, 255))[0] for z in (x, y)]
    assert images.similarity(a, b) == pytest.approx(0.7 * np.corrcoef(x.ravel(), y.ravel())[0, 1] + 0.3 * np.corrcoef(*h)[0, 1])
    assert images.similarity(a, np.full((10, 10), 5.0)) == pytest.approx(0.3 * images.correlation(images.histogram(images.resize(a, 10, 10)), images.histogram(np.full((10, 10), 5.0))))


def test_targets_of_one_number_are_kept_apart(spark):
    image = lambda v: {"h": 1, "w": 4, "data": [float(x) for x in v]}
    targets = spark.createDataFrame([(1, "f", "12", image([0.0, 10, 20, 30])), (2, "f", "12", image([30.0, 20, 10, 0]))], "k int, field string, expected string, image struct<h:int,w:int,data:array<double>>")
    refs = spark.createDataFrame([("f", f"12_{i}.png", image([0.0, 10, 20, 30])) for i in range(7)] + [("f", "13_1.png", image([9.0, 9, 9, 9]))], "field string, filename string, image struct<h:int,w:int,data:array<double>>")
    got = {r.k: r for r in images.reference_matches(targets, refs, key=("k",)).collect()}
    assert got[1].n == got[2].n == 5 and got[1].matches and not got[2].matches


# --- readers ---


@pytest.fixture
def folder(tmp_path):
    for name in ("b.pdf", "a.PDF", "sub/c.pdf", "node_modules/d.pdf", ".git/e.pdf", "x.png", "y.jpg", "a.png", "z.PNG", ".hidden.png", "field/correct/12_1.png", "field/error/13_detected_31_2.jpg", "field/other/1_1.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
    return tmp_path


def names(df, column="path"):
    return [Path(r[column]).name for r in df.collect()]


def test_folders(spark, folder):
    assert sorted(names(readers.pdfs(spark, str(folder)))) == ["a.PDF", "b.pdf", "c.pdf"]
    assert names(readers.launched(spark, str(folder)).orderBy("seq")) == ["a.png", "x.png", "y.jpg"]
    refs = readers.reference_files(spark, str(folder))
    assert sorted(names(refs)) == ["12_1.png", "13_detected_31_2.jpg"]
    parsed = sorted((r.field, r.outcome, r.expected, r.detected) for r in mining.references(refs).collect())
    assert parsed == [("field", "correct", "12", None), ("field", "error", None, None)]
    wanted = spark.createDataFrame([("field", "correct"), ("field", "error"), ("none", "correct")], "field string, outcome string")
    counts = {(r.field, r.outcome): r.n for r in readers.image_counts(mining.references(refs), wanted).collect()}
    assert counts == {("field", "correct"): 1, ("field", "error"): 1, ("none", "correct"): 0}
    assert ".hidden.png" not in names(readers.queue(spark, str(folder)))


def test_newest_new_file(spark, tmp_path):
    (tmp_path / "old.txt").write_text("1")
    before = spark.createDataFrame(readers.files(spark, str(tmp_path)).collect())
    assert readers.newest_new(readers.files(spark, str(tmp_path)), before).collect() == []
    for name, at in (("first.txt", 1_000), ("last.txt", 2_000)):
        (tmp_path / name).write_text("1")
        os.utime(tmp_path / name, (at, at))
    assert names(readers.newest_new(readers.files(spark, str(tmp_path)), before)) == ["last.txt"]


def test_lists_and_lines(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" /a/b.pdf \n\n\t\n/c d.pdf\n/a/b.pdf\n")
    assert [r.path for r in readers.path_list(spark, str(tmp_path / "list.txt")).collect()] == ["/a/b.pdf", "/c d.pdf", "/a/b.pdf"]
    assert sorted(r.document_id for r in readers.done_ids(spark, str(tmp_path / "list.txt")).collect()) == ["/a/b.pdf", "/c d.pdf"]
    assert readers.done_ids(spark, str(tmp_path / "none.txt")).collect() == []
    page = {"n": 1, "chars": 3, "provider": "rapid", "conf": 0.79, "text": "abc"}
    lines = [json.dumps({"path": "a", "pages": [page]}), "{not json", json.dumps({"path": "b", "pages": []}), json.dumps({"path": "c", "pages": [page | {"conf": 0.8}, page | {"provider": "textlayer", "conf": 1.0}, page | {"conf": None}]})]
    (tmp_path / "batch.jsonl").write_text("\n".join(lines))
    batch = readers.batch_lines(spark, str(tmp_path / "batch.jsonl"))
    assert report.totals(batch).first().asDict() == {"docs": 3, "pages": 4, "chars": 12, "textlayer": 1, "ocr": 3}
    assert [(r.path, r.min_conf, r.low_pages) for r in report.review_queue(batch).collect()] == [("c", 0.0, 1), ("a", 0.79, 1)]
    (tmp_path / "results.jsonl").write_text(json.dumps({"document_id": "1", "success": True}) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.results(spark, str(tmp_path / "results.jsonl")).collect()
    assert readers.results(spark, str(tmp_path / "none.jsonl")).collect() == []


def test_corrections(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1_metadata.json").write_text(json.dumps({"correction_id": "1", "expected": {"f": "1"}, "detected": {"f": None}, "corrected": {"f": "1"}}, indent=1))
    (tmp_path / "a/2_metadata.json").write_text("{")
    (tmp_path / "other.json").write_text(json.dumps({"correction_id": "3"}))
    found = feedback.flagged(readers.corrections(spark, str(tmp_path))).collect()
    assert [(r.correction_id, r.errors, r.detected) for r in found if r.correction_id] == [("1", {"f_was_wrong": False, "both_wrong": False}, {"f": "N/A"})]
    assert readers.corrections(spark, str(tmp_path / "none")).collect() == []


def test_decoded_images(spark, tmp_path):
    import io

    x = np.arange(6, dtype=np.uint8).reshape(2, 3)
    held = io.BytesIO()
    np.save(held, x)
    rows = [("npy", held.getvalue()), ("pgm", b"P5\n# note\n3 2\n255\n" + x.tobytes()), ("bad", b"not an image"), ("cut", b"P5\n3 2\n255\n\0")]
    got = {r.name: r.image for r in readers.decode_arrays(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["bad"] is None and got["cut"] is None
    assert got["npy"].data == got["pgm"].data == x.ravel().tolist() and (got["npy"].h, got["npy"].w) == (2, 3)


def test_ragged_sheets(spark, tmp_path):
    with (tmp_path / "s.csv").open("w", newline="") as f:
        csv.writer(f).writerows([["h", "r"], ["1", ""], ["2"], ["a,b", 'q"q', "line\nbreak"]])
    got = {r.row_number: r.cells for r in readers.csv_sheet(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {1: ["h", "r"], 2: ["1", ""], 3: ["2"], 4: ["a,b", 'q"q', "line\nbreak"]}
    rows = readers.csv_sheet(spark, str(tmp_path / "s.csv"))
    assert sorted(r.row_number for r in readers.unprocessed(rows, ["B"]).collect()) == [2, 3]
    assert sorted(r.row_number for r in readers.unprocessed(rows, ["B"], force=True, from_row=3).collect()) == [3, 4]
    assert [readers.column_index(x) for x in ("A", "Z", "AA", "az")] == [0, 25, 26, 51] and readers.column_letter(26) == "AA"
    with pytest.raises(ValueError):
        readers.column_index("1")
    (tmp_path / "s.json").write_text(json.dumps([{"a": "1"}, {"b": "2", "a": "3"}], indent=2))
    assert {r.row_number: r.cells for r in readers.json_sheet(spark, str(tmp_path / "s.json"), ["a", "b"]).collect()} == {1: ["1", ""], 2: ["3", "2"]}


# --- sinks and backends ---


def test_snapshots_may_be_read_from_where_they_go(spark, tmp_path):
    path = str(tmp_path / "state")
    sinks.snapshot(spark.range(3), path)
    sinks.snapshot(spark.read.parquet(path).selectExpr("id + 1 AS id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    sinks.clear(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 0 and os.listdir(tmp_path) == ["state"]
    default = spark.createDataFrame([("d",)], "s string")
    assert readers.state(spark, str(tmp_path / "none"), "s string", default).first().s == "d"


def test_appended_results(spark, tmp_path):
    df = spark.createDataFrame([("1", True, "secret")], "document_id string, success boolean, raw_text string")
    for _ in range(2):
        sinks.append_results(df, str(tmp_path / "r"))
    got = readers.results(spark, str(tmp_path / "r")).collect()
    assert [(r.document_id, r.success) for r in got] == [("1", True)] * 2
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    failed = spark.createDataFrame([(2, "b.jpg", None, "broken"), (1, "a.png", True, None)], "seq int, file string, success boolean, error string")
    sinks.write_launched(failed, str(tmp_path / "launched"))
    (one,) = (tmp_path / "launched").glob("part-*.json")
    assert [json.loads(x) for x in one.read_text().splitlines()] == [{"file": "a.png", "success": True}, {"file": "b.jpg", "error": "broken"}]


def test_upserts_grow_and_the_last_wins(spark):
    sheet = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "row_number int, cells array<string>")
    updates = spark.createDataFrame([(1, 2, "A", "x"), (2, 2, "a", "y"), (3, 4, "AB", "z")], "seq int, row_number int, letter string, value string")
    got = {r.row_number: r.cells for r in sinks.upserted(sheet, updates).collect()}
    assert got == {1: ["a"], 2: ["y", "c"], 3: [], 4: [""] * 27 + ["z"]}
    assert sinks.upserted(sheet.limit(0), updates.limit(0)).collect() == []


def test_moved_files(tmp_path):
    for folder in ("q", "done"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.png").write_text(folder)
    assert Path(sinks.move_file(str(tmp_path / "q/a.png"), str(tmp_path / "done"))).name == "a_1.png"
    assert not (tmp_path / "q/a.png").exists() and (tmp_path / "done/a.png").read_text() == "done"


def test_report_page(spark):
    page = sinks.html_report(jobs.sample_batch(spark, 120), "<title>")
    assert "&lt;title&gt;" in page and "120 documents" in page and "rapid_ocr" in page and "To review: 10" in page


def test_backends(spark, tmp_path):
    update = lambda *rows: spark.createDataFrame(rows, "row_number int, letter string, value string")
    sheet = sheets.CsvSheet(spark, str(tmp_path / "c"))
    assert sheet.rows().collect() == []
    sheet.update(update((2, "B", 'x,"y"'), (1, "A", "line\nbreak")))
    assert {r.row_number: r.cells for r in sheet.rows().collect()} == {1: ["line\nbreak"], 2: ["", 'x,"y"']}

    class Live:
        cells = [["h", "s"], ["1"]]
        written = []

        def get_all_values(self):
            return self.cells

        def update_acell(self, cell, value):
            self.written.append((cell, value))

    cloud = sheets.CloudSheet(spark, lambda credentials: Live(), variable="NO_SUCH_VARIABLE")
    assert not cloud.available()
    with pytest.raises(FileNotFoundError):
        cloud.rows()
    cloud = sheets.CloudSheet(spark, lambda credentials: Live(), "key.json")
    assert [r.cells for r in cloud.rows().orderBy("row_number").collect()] == [["h", "s"], ["1"]]
    cloud.update(update((2, "B", "ok"), (1, "A", "")))
    assert Live.written == [("B2", "ok")]


# --- providers ---


def test_engines_fail_by_row_and_start_once_a_worker(spark):
    def recognise(engine, x):
        if x == "bad":
            raise ValueError(x)
        return (x.upper(), [0.5, 1.0]) if x else ("", [])

    docs = spark.createDataFrame([("a",), ("bad",), ("",)], "path string")
    got = {r.path: r.reading for r in providers.Engine("e", object, recognise)(docs).collect()}
    assert got["bad"] is None and tuple(got["a"]) == ("A", 0.75, "e") and tuple(got[""]) == ("", 0.0, "e")


def test_availability(monkeypatch):
    probe = lambda **x: providers.Engine("e", object, lambda e, x: ("", []), **x).available()
    assert probe() and probe(requires=("json",)) and not probe(requires=("no_such_module_here",))
    assert probe(binaries=("sh",)) and not probe(binaries=("no-such-program",))
    monkeypatch.setenv("SOME_KEY", "1")
    assert probe(credentials=("OTHER", "SOME_KEY")) and not probe(credentials=("OTHER_KEY_THAT_ISNT",))
    assert not probe(url="http://127.0.0.1:9/none")
    assert {providers.known(n).name for n in ("rapid_ocr", "tesseract", "surya", "google_vision")} == {"rapid_ocr", "tesseract", "surya", "google_vision"}


@pytest.mark.parametrize(
    "fast, accurate, expected",
    [
        (("RESULT", 0.95), ("NO", 0.99), ("RESULT", 0.95, "fast")), (("PARTIAL", 0.6), ("FULL TEXT", 0.95), ("FULL TEXT", 0.95, "accurate")), (("A", 0.9), ("B", 0.99), ("A", 0.9, "fast")),
        (("A", 0.89), ("B", 0.1), ("B", 0.1, "accurate")), (("A", 0.4), ("", 0.0), ("A", 0.4, "fast")), (None, None, ("", 0.0, "cascade")), (None, ("B", 0.2), ("B", 0.2, "accurate")),
    ],
)
def test_cascade_cases(spark, fast, accurate, expected):
    def provider(name, found):
        r = F.lit(None).cast(cascade.READING) if found is None else cascade.reading(F.lit(found[0]), F.lit(found[1]), F.lit(name))
        return lambda df: df.withColumn("reading", r)

    got = cascade.cascade(spark.range(1), provider("fast", fast), provider("accurate", accurate)).first()
    assert tuple(got.reading) == expected


def test_a_blank_answer_of_the_corrector_changes_nothing(spark):
    fast, accurate = (providers.Expression(n, F.lit(t), F.lit(c)) for n, t, c in (("fast", "bad txt", 0.5), ("accurate", "g00d txt", 0.8)))
    read = lambda corrector: tuple(cascade.cascade(spark.range(1), fast, accurate, corrector=corrector).first().reading)
    assert read(lambda t: F.replace(t, F.lit("g00d"), F.lit("good"))) == ("good txt", 0.8, "accurate+llm")
    assert read(lambda t: F.lit("  ")) == ("g00d txt", 0.8, "accurate") == read(lambda t: F.lit(None).cast("string"))


# --- jobs ---


def test_machines_resume_and_try_again(spark, tmp_path):
    tries, seen = [], []

    def flaky(context):
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("not yet")
        return "b"

    def stop(context):
        seen.append(context["x"])
        if len(seen) == 1:
            raise RuntimeError("crash")
        return None

    store = jobs.Store(spark, str(tmp_path / "machine"))
    states = {"a": jobs.State(flaky, retries=3), "b": jobs.State(stop)}
    with pytest.raises(RuntimeError):
        jobs.StateMachine(states, store).run({"x": 1})
    assert store.load() == ("b", ["a"]) and len(tries) == 3
    machine = jobs.StateMachine(states, store)
    assert machine.run({"x": 2}) == {"x": 2} and seen == [1, 2] and machine.history == ["b"] and store.load()[0] == jobs.END
    with pytest.raises(ValueError):
        tries.clear()
        jobs.StateMachine({"a": jobs.State(flaky, retries=2)}).run()


def test_runs_resume(spark, tmp_path):
    items = jobs.sample_documents(spark, 30)
    run = lambda steps=(), n=3: jobs.run_resumable(items, extract.ID_CARD, str(tmp_path / "r"), str(tmp_path / "d"), n, steps)

    def broken(results):
        return results.withColumn("x", F.raise_error(F.lit("while it runs")).cast("string"))

    with pytest.raises(Exception, match="while it runs"):
        run([jobs.Step("broken", broken, on_error="stop")])
    first = run([jobs.Step("broken", broken)])
    assert (first["total"], first["succeeded"], first["failed"], first["skipped"]) == (30, 0, 30, 0)
    count = jobs.Step("count", lambda results, context: (results, context | {"n": context.get("n", 0) + 1}), with_context=True)
    second = run([count])
    assert (second["succeeded"], second["failed"], second["skipped"], second["context"]) == (30, 0, 0, {"n": 3})
    assert run()["skipped"] == 30


def test_keys_may_be_expressions(spark):
    items = spark.createDataFrame([("/x/a.png", 1, "t"), ("/y/a.png", 2, "t"), ("/y/b.png", 3, "t")], "path string, seq int, text string")
    got = jobs.run_batch(items, extract.ID_CARD, key=F.element_at(F.split("path", "/"), -1))
    assert sorted((r.document_id, r.seq) for r in got.collect()) == [("a.png", 1), ("b.png", 3)]
    skip = jobs.Step("skip", lambda df: df.select("no_such_column"))
    assert jobs.run_batch(items, extract.ID_CARD, steps=[skip], key=F.col("path")).count() == 3
    with pytest.raises(Exception, match="no_such_column"):
        jobs.run_batch(items, extract.ID_CARD, steps=[jobs.Step("stop", skip.fn, on_error="stop")], key=F.col("path")).count()


def test_feedback_stream(spark, tmp_path):
    """Rules are learned from all corrections that came so far."""
    raw = "seq long, expected map<string,string>, detected map<string,string>, corrected map<string,string>"

    def arrive(first, wrong):
        rows = [(first + i, {"f": "e"}, {"f": "d"}, {"f": "c" if i < wrong else "e"}) for i in range(4)]
        feedback.flagged(spark.createDataFrame(rows, raw)).write.mode("append").parquet(str(tmp_path / "in"))

    for n, wrong in enumerate((1, 3)):
        arrive(10 * n, wrong)
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.retrained(stream, str(tmp_path / "store"), str(tmp_path / "rules"), str(tmp_path / "checkpoint")).awaitTermination()
        rules = spark.read.parquet(str(tmp_path / "rules")).collect()
        assert [(r.detected, r.correction, r.frequency, r.expected_precision) for r in rules] == ([] if n == 0 else [("d", "c", 4, 0.5)])


def test_appearing_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"1")
    stream = streaming.files_appearing(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert names(spark.read.parquet(str(tmp_path / "out"))) == ["a.bin"]


def test_configuration_after_one_analysis(spark):
    config = spark.createDataFrame([("f", (0.05, 0.97, 0.2, 0.8), ("otsu", 3, False), 0.5, [])], "field string, roi struct<top:double,bottom:double,left:double,right:double>, preprocessing struct<threshold:string,blur_kernel:int,clahe:boolean>, min_confidence double, correction_rules array<struct<type:string,pattern:string>>")
    refs = spark.createDataFrame([("f", "correct", "12345_1000.png"), ("f", "correct", "12346_1001.png"), ("f", "error", "12347_detected_012347_1002.png")], "field string, outcome string, filename string")
    refs = refs.withColumn("p", T.parse_reference_name(F.col("filename"))).select("field", "outcome", "filename", "p.*")
    rates, found = mining.success_rates(refs), mining.patterns(refs.withColumn("seq", F.lit(1)))
    features = spark.createDataFrame([("f", "correct", 100.0, 10.0), ("f", "error", 79.0, 8.0)], "field string, outcome string, brightness double, sharpness double")
    r = mining.adjusted(config, rates, found, features).first()
    assert [tuple(x) for x in r.correction_rules] == [("strip_prefix", "0")] and r.n_changes == 2
    assert r.preprocessing.threshold == "clahe" and r.preprocessing.blur_kernel == 3 and r.roi.top == 0.05
    assert rates.first().rate == pytest.approx(200 / 3)


