"""The drawing engine on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from sheetlake import config
from sheetlake.functions import exprs as X
from sheetlake.functions import paths
from sheetlake.operators import evidence, extract, ocr, parse, registry, review, tiles
from sheetlake.sources import files, json_text, pdf, providers


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("expr, given, want", [
    (X.clean_scalar, "  N/A\n", None), (X.clean_scalar, " Ã˜5 ", "Ø5"), (X.unit, "Milli­meters", "Milli­meters"), (X.unit, "Millimeters.", "mm"), (X.unit, '"', "in"),
    (X.dimension_type, "Hole diameter", "diameter"), (X.dimension_type, None, "unknown"), (X.dimension_type, "pitch", "pattern"), (X.value_key, " 1,83 ", "1.83"),
    (X.quantity_key, "4.0", "4"), (X.quantity_key, " ", None), (X.text_key, " Pad \t Diameter ", "pad diameter"), (X.ocr_text, " (X7) #1,02", "(x7)Ø1.02"), (X.is_numeric_candidate, "5STUB", False), (X.is_numeric_candidate, "x٣", True),
    (X.ocr_class, "2:1", "ratio_or_scale_candidate"), (X.ocr_class, "ø3", "diameter_candidate"), (X.ocr_class, "(X4)", "quantity_candidate"), (X.ocr_class, "12", "numeric_candidate"), (X.metadata_field, "Rev_Date.", "revision_date"), (X.metadata_field, "product name", None),
    (X.output_slug, "DEMO_AB12_Technical_Drawing_page-0001", "demo_ab12"), (X.output_slug, "page 1", "page_1"), (X.output_slug, "--", "drawing"), (X.media_type, "a/B.JPG", "image/jpeg"), (X.json_object, "x ```json {\"a\": {}} ```", '{"a": {}}'), (X.json_object, "} {", None),
])
def test_expressions(spark, expr, given, want):
    assert one(spark, given, expr) == want


def test_comparison_keys(spark):
    assert one(spark, "(x7)Ø1.02", X.comparison_keys) == ["(x7)Ø1.02", "(x7)1.02", "Ø1.02", "1.02"]
    assert one(spark, "Ø", X.comparison_keys) == ["Ø"]


def model_positions(length, tile, overlap, least):
    if length <= tile:
        return [0]
    out, at, step = [], 0, max(1, tile - overlap)
    while length - at > tile:
        out.append(at)
        at += step
    return [*out, at if length - at >= least else length - tile]


def test_tiles(spark):
    lengths = [1, 1024, 1025, 1200, 1754, 1792, 2481, 3508, 4961, 10000]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    for tile, overlap, least in ((1024, 256, 384), (100, 100, 10), (64, 0, 64)):
        got = {r.n: r.p for r in df.select("n", X.axis_positions(F.col("n"), tile, overlap, least).alias("p")).collect()}
        assert got == {n: model_positions(n, tile, overlap, least) for n in lengths}
    pages = spark.createDataFrame([("f", 1, 2481, 1754), ("f", 2, 1200, 800), ("g", 1, 4961, 3508), ("g", 2, 0, 5), ("g", 3, None, None)], "file string, page int, width int, height int")
    rows = tiles.tiles(pages, ["file"]).orderBy("file", "page", "ordinal").collect()
    assert [sum((r.file, r.page) == k for r in rows) for k in (("f", 1), ("f", 2), ("g", 1), ("g", 2))] == [6, 2, 35, 0]
    last = [r for r in rows if (r.file, r.page) == ("f", 1)][-1]
    assert (last.x + last.width, last.y + last.height) == (2481, 1754) and last.tile_id == "page_001_tile_006"
    assert tiles.full_page_regions(pages, ["file"]).filter("w IS NULL").count() == 1


def test_boxes(spark):
    c = lambda *v: [F.lit(x) for x in v]
    got = spark.range(1).select(X.crop_box(*c(5, 5, 20, 10), *c(500, 300)).alias("a"), X.crop_box(*c(5, 5, 0, 10), *c(500, 300)).alias("b")).first()
    assert tuple(got.a) == (0, 0, 384, 300) and got.b is None
    p = one(spark, [[10.2, 20.4], [30.9, 20.0], [31.5, 40.8], [9.7, 41.2]], X.polygon_box, "array<array<double>>")
    assert tuple(p) == (9, 20, 22, 21)


RESPONSE = {
    "brand_name": " ACME ", "product_name": "widget42.v1", "size": "", "scale": "A3", "revision": "null", "surprise": 1,
    "dimensions": [{"raw_text": "#5", "value": 5, "unit": "Millimeters", "type": "hole diameter", "label": "#5", "quantity": 4}, "bad", {"type": "made up"}],
    "tables": [{"type": "pinout_table", "columns": ["Pin", "Signal"], "rows": [{"values": [1, "VCC"]}, {"label": "2", "cells": [{"column": "Pin", "value": "2"}, {"column": "Signal", "value": "GND"}]}]}],
    "schematics": [{"title": "S", "components": ["R1", None, 3], "parameters": [{"label": "V", "value": "5"}, 7]}], "notes": [{"a": 1}, "n"], "tolerances": {},
}


def test_products(spark):
    rows = [("acme_widget42.pdf", "```json\n" + json.dumps(RESPONSE) + "\n```"), ("b.pdf", "no json"), ("c.pdf", None), ("d.pdf", '{"warnings": ["w"], "notes": "x"}')]
    got = {r.source_file: r for r in parse.products(spark.createDataFrame(rows, "file_name string, raw_response string")).collect()}
    a = got["acme_widget42.pdf"]
    plain = lambda v: v if v is None else v.toPython()
    assert (plain(a.brand_name), plain(a["size"]), a.scale, a.revision) == ("ACME", "A3", None, None) and len(a.dimensions) == 2
    d = a.dimensions[0]
    assert (plain(d.raw_text), plain(d.value), plain(d.unit), d.type, plain(d.quantity), d.label) == ("#5", 5, "mm", "diameter", 4, None)
    t = a.tables[0]
    assert t.columns == ["Pin", "Signal"] and [[c.toPython() for c in r["values"]] for r in t.rows] == [[1, "VCC"], ["2", "GND"]] and t.rows[0].cells is None and t.rows[1].label is None
    assert a.schematics[0].components == ["R1"] and len(a.schematics[0].parameters) == 1 and json.loads(a.notes) == [{"a": 1}, "n"] and a.tolerances == "[]"
    assert a.warnings == [
        "Semantic extraction is not implemented yet.", "Moved sheet size value from `scale` to `size`.", "`product_name` may contain a source filename or file extension: `widget42.v1`.",
        "`tolerances` was not a list and was reset.", "Suspicious diameter symbol in raw_text: `#5`.", "Dimension 2 was not an object and was skipped.",
        "Dimension 3 type `made up` is not allowed and was set to unknown.", "schematics item 1 parameter 2 was not an object and was skipped.",
    ]
    assert got["b.pdf"].status == got["c.pdf"].status == "validation_failed" and got["b.pdf"].dimensions == []
    assert got["d.pdf"].warnings == ["w", "`notes` was not a list and was reset."]


def test_refinements(spark):
    good = {"classification": "Dimension", "confidence": True, "local_context": "Title block", "dimension": {"raw_text": "5"}, "metadata": None, "is_product_dimension": True, "ocr_text_supported": "yes"}
    rows = [("t1", json.dumps(good)), ("t2", "{}"), ("t3", "oops"), ("t4", '{"classification": "x", "confidence": 0.5, "dimension": 3, "local_context": "moon"}')]
    got = {r.target_id: r for r in parse.refinements(spark.createDataFrame(rows, "target_id string, raw_response string")).collect()}
    assert (got["t1"].classification, got["t1"].confidence, got["t1"].local_context, got["t1"].dimension.raw_text.toPython(), got["t1"].ocr_text_supported) == ("dimension", None, "title_block", "5", None) and not got["t1"].warnings
    assert got["t2"].classification == "uncertain" and got["t2"].warnings == [] and got["t2"].status == "completed" and len(got["t3"].warnings) == 1 and len(got["t4"].warnings) == 3


def candidates(spark, rows):
    df = spark.createDataFrame(rows, "candidate_id string, page int, raw_text string, value string, type string, label string, quantity string, x int, y int, width int, height int")
    return evidence.dedupe_keys(df.withColumn("f", F.lit(1)))


def test_duplicates_and_support(spark):
    c = candidates(spark, [(f"t{i}", 1, v, v, "diameter", "PAD DIAMETER", "1", x, 0, 1024, 1024) for i, (v, x) in enumerate([("1,83", 0), ("1.83", 768), ("1.83", 2200)])])
    g = evidence.duplicate_groups(c, ["f"]).collect()
    assert [(r.members, r.score, r.classification, r.review_action) for r in g] == [(2, 75, "strong_duplicate", "merge_evidence_only")] and g[0].score_reasons == ["same page/value/type", "same label", "same quantity"]
    # another document with the same ids has nothing to do with it, and a box of any size is dealt with
    other = candidates(spark, [("t0", 1, "9", "9", None, None, None, 0, 0, 10, 10), ("t1", 1, "9", "9", None, None, None, 5, 5, 2_000_000_000, 2_000_000_000)]).withColumn("f", F.lit(2))
    lone = candidates(spark, [("t0", 1, "1.83", "1.83", "diameter", "PAD DIAMETER", "1", 0, 0, 1024, 1024)]).withColumn("f", F.lit(3))
    every = c.unionByName(other).unionByName(lone)
    assert sorted((r.f, r.members) for r in evidence.duplicate_groups(every, ["f"]).collect()) == [(1, 2), (2, 2)]
    assert sorted((r.f, r.candidate_id) for r in evidence.overlapping_members(every, ["f"]).collect()) == [(1, "t0"), (1, "t1"), (2, "t0"), (2, "t1")]
    assert {(r.f, r.status) for r in evidence.support(every, c.limit(1), ["f"]).collect()} == {(1, "full_page_supported"), (2, "tile_only"), (3, "tile_only")}
    full = candidates(spark, [("p1", 1, "1.83", "1.83", "diameter", None, None, 0, 0, 1, 1), ("p2", 1, "1.83", "1.83", "diameter", "other", None, 0, 0, 1, 1)])
    assert [(r.matches, r.status, r.matching_ids) for r in evidence.support(c, full, ["f"]).collect()] == [(1, "full_page_supported", ["p1"])] * 3
    touching = candidates(spark, [("a", 1, "2", "2", None, None, None, 0, 0, 10, 10), ("b", 1, "2", "2", None, None, None, 10, 0, 10, 10)])
    assert evidence.duplicate_groups(touching, ["f"]).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_support_is_counted_without_ids(spark):
    some = lambda i, p: candidates(spark, [(f"{p}{j}", j % 2 or None, "1", (None, "1", "2")[j % 3], "linear", (None, "a", "b")[j // 3 % 3], (None, "1", "2.0", "2")[(j * i) % 4], 0, 0, 1, 1) for j in range(72)]).withColumn("context", F.lit(None).cast("string"))
    c, full = some(1, "t"), some(5, "p")
    counted = evidence.support_counts(c, full, ["f"])
    want = {r.candidate_id: (r.matches, r.status) for r in evidence.support(c, full, ["f"]).collect()}
    assert {r.candidate_id: (r.matches, r.status) for r in counted.collect()} == want and counted.count() == 72 and len({m for m, _ in want.values()}) > 3
    # nothing that grows with the matches is moved, neither here nor for a review's counts
    for df in (counted, evidence.tile_summary(c, full, ["f"])["counts"]):
        assert "collect_list" not in _plan(df)


def test_members_are_found_without_pairs(spark):
    # boxes of all sizes: the larger of two that overlap is found by the smaller one, and the other way round
    boxes = [(f"t{i}", 1, "2", "2", None, None, None, i * 7919 % 20011, i * 104729 % 20021, (9, 300, 1500, 9000)[i % 4], (40, 5, 1100, 70)[i % 4]) for i in range(160)]
    hit = lambda a, b: a[7] < b[7] + b[9] and b[7] < a[7] + a[9] and a[8] < b[8] + b[10] and b[8] < a[8] + a[10]
    want = sorted(a[0] for a in boxes if any(a[0] != b[0] and hit(a, b) for b in boxes))
    members = evidence.overlapping_members(candidates(spark, boxes), ["f"])
    assert sorted(r.candidate_id for r in members.collect()) == want and 10 < len(want) < 150
    assert "Join Inner" not in _plan(members) and "Join LeftSemi" in _plan(members)


def test_registry(spark):
    files_ = spark.createDataFrame([("b/X", "1"), ("a/x", "1"), ("c", "2"), ("d", "3")], "path string, fingerprint string")
    log = spark.createDataFrame([(1, "2", "completed", "r1"), (2, "3", "failed", None), (3, "2", "completed", "r2")], "seq long, fingerprint string, status string, result_path string")
    assert sorted(r.path for r in registry.to_process(files_, log).collect()) == ["a/x", "d"]
    assert registry.to_process(files_, log, force=True).count() == 4
    assert [r.result_path for r in registry.latest_completed(log).collect()] == ["r2"]
    assert tuple(registry.status_counts(log).first()) == (3, 2, 1)


@pytest.mark.parametrize("value, type_, raw, label, context, want", [
    ("2:1", "Pattern", "2:1", "A", None, "non_product_candidate"), ("1", None, " R12 ", "A", None, "non_product_candidate"), ("1", None, "x", "A", "Power  Transformer", "non_product_candidate"),
    ("5", "linear", "5", None, None, "weak_tile_only"), ("5", "linear", "5", "  ", None, "weak_tile_only"), ("1", "linear", "1", "A", None, "weak_tile_only"), ("5", "linear", "5", "A", None, "tile_only_candidate"),
])
def test_tile_only_class(spark, value, type_, raw, label, context, want):
    row = spark.createDataFrame([(value, type_, raw, label, context)], "v string, t string, r string, l string, c string")
    assert row.select(evidence.tile_only_class(*[F.col(x) for x in "vtrlc"])).first()[0] == want


def test_candidates_and_summary(spark):
    body = lambda *d: json.dumps({"dimensions": list(d)})
    one_ = {"raw_text": "1,83", "value": 1.83, "type": "diameter", "label": "PAD DIAMETER", "quantity": 1}
    rows = [("a.png", f"t{i}", 1, x, 0, 1024, 1024, body(one_, {"raw_text": "7", "value": 0})) for i, x in enumerate((0, 768, 2200))] + [("b.png", "t0", 1, 0, 0, 10, 10, body())]
    asked = spark.createDataFrame(rows, "file_name string, tile_id string, page int, x int, y int, width int, height int, raw_response string")
    made = parse.products(asked, ("file_name", "tile_id", "page", "x", "y", "width", "height"))
    c = evidence.tile_candidates(made, ["file_name"])
    got = {r.candidate_id: r for r in c.collect()}
    assert len(got) == 6 and got["t0_dimension_001"].k_value == "1.83" and got["t0_dimension_001"].k_quantity == "1" and got["t0_dimension_002"].k_value == "7"
    full = evidence.full_page_candidates(parse.products(spark.createDataFrame([("a.png", body({**one_, "label": None, "value": "1,83"}))], "file_name string, raw_response string"), ("file_name",)), ["file_name"])
    s = evidence.tile_summary(c, full, ["file_name"])
    assert s["supported"].count() == 3 and s["tile_only"].count() == 3 and s["unique"].count() == 2
    counts = s["counts"].first()
    assert (counts.strong_duplicate_groups, counts.weak_duplicate_groups, counts.full_page_supported_candidates, counts.tile_only_candidates, counts.weak_tile_only_candidates) == (1, 1, 3, 3, 3)


def test_tables_keep_their_columns(spark):
    def table(**t):
        return parse.tables(spark.createDataFrame([(json.dumps(t),)], "j string"), "j").first().t

    got = table(columns=[1, "A", "B"], rows=[{"values": ["x", "y", 5]}])
    assert [(c.column and c.column.toPython(), c.value.toPython()) for c in got.rows[0].cells] == [("A", "x"), ("B", "y"), (None, 5)] and got.columns is None
    got = table(columns=["L", "A"], rows=[{"label": "n/a", "values": [1]}, {"label": "", "values": [2]}])
    assert got.columns == ["A"] and [[v.toPython() for v in r["values"]] for r in got.rows] == [[1], [2]]
    got = table(rows=[{"label": "Pin 1", "cells": [{"column": "Pin Number", "value": "1"}]}, {"label": "Pin 1", "cells": [{"column": "Pin Number", "value": 1}]}])
    assert [r.label and r.label.toPython() for r in got.rows] == [None, "Pin 1"]
    assert table(columns=[" A "], rows=[{"values": [1]}, {"cells": [{"column": "A", "value": 2}]}]).columns == ["A"]
    assert table(columns=["A"], rows=[{"values": [1]}, {"cells": [{"column": 3, "value": 2}]}]).columns is None


def read(spark, text, name="a.pdf"):
    return parse.products(spark.createDataFrame([(name, text)], "file_name string, raw_response string")).first()


@pytest.mark.parametrize("text, want", [
    ('{"sheet": "1", "sheet": "2"}', "2"), ('{"sheet": "1"} tail', "1"), ('x {"sheet": 1.0}', 1.0), ('{"sheet": 1}', 1), ('{"sheet": true}', True), ('{"sheet": ["a"]}', ["a"]), ('{"sheet": {"b": 1}}', {"b": 1}), ('{"sheet": 1e400}', float("inf")),
    ('{"sheet": -Infinity}', float("-inf")), ('{"sheet": " N/A "}', None), ('{"sheet": null}', None), ('{"sheet": "\\ud800"}', "?"), ('{"sheet": 12345678901234567890123}', 12345678901234567890123), ('```json {"sheet": 1}\n{"sheet": "in"}\n```', "in"),
])
def test_values_keep_their_types(spark, text, want):
    got = read(spark, text)
    value = got.sheet and got.sheet.toPython()
    assert value == want and type(value) in (type(want), __import__("decimal").Decimal) and got.status == "completed"


@pytest.mark.parametrize("text", ['{"a": 1} {"b": 2}', "{'a': 1}", '{"a": 1,}', "[1, 2]", "", '{"a": 01}', '{"a": "\t"}', "} {", '{"a": ' + "[" * 100000 + "]" * 100000 + "}"])
def test_texts_that_are_not_one_value(spark, text):
    got = read(spark, text)
    try:
        json.loads(text[text.index("{"):text.rindex("}") + 1])
    except RecursionError:
        said = "nested too deeply"
    except ValueError as e:
        said = "No JSON object found." if "{" not in text or text.rindex("}") < text.index("{") else str(e)
    assert got.status == "validation_failed" and got.warnings == [f"Extractor response was not valid JSON: {said}"]


def test_kinds_that_warn_and_kinds_that_do_not(spark):
    answer = {"dimensions": [{"type": 5, "unit": 7, "raw_text": 3, "label": ["x"]}, {"type": "pad"}, "x"], "dimension_tables": [{"type": "pinout_table", "rows": None}], "tables": [{"type": 4, "rows": [{}, 3]}], "schematics": [{"parameters": None}, {"parameters": 3}], "warnings": ["own", 5, {"a": None}]}
    got = read(spark, json.dumps(answer))
    d = got.dimensions[0]
    assert (d.type, d.unit.toPython(), d.raw_text.toPython(), d.label.toPython()) == ("unknown", 7, 3, ["x"])
    assert "type" not in got.dimension_tables[0] and got.dimension_tables[0].rows == [] and got.tables[0].type == "unknown"
    assert got.warnings == [
        "own", "5", '{"a":null}', "Dimension 2 type `pad` is not allowed and was set to unknown.", "Dimension 3 was not an object and was skipped.", "dimension_tables item 1 rows were not a list and were reset.",
        "tables item 1 row 1 had no cells or values and was reset.", "tables item 1 row 2 was not an object and was skipped.", "schematics item 2 parameters was not a list and was reset.",
    ]


def test_refinement_warnings_are_kept(spark):
    answers = {
        "a": {"classification": 5, "warnings": ["model said"], "dimension": {"type": "zzz", "raw_text": "#1", "label": "diameter"}}, "b": {"classification": None, "confidence": None, "warnings": None, "local_context": 3, "metadata": 4, "dimension": []},
        "c": {"classification": " Note ", "confidence": 1, "dimension": None, "metadata": None}, "d": {"confidence": "0.9"},
    }
    rows = [(k, json.dumps(v)) for k, v in answers.items()]
    got = {r.target_id: r for r in parse.refinements(spark.createDataFrame(rows, "target_id string, raw_response string")).collect()}
    assert got["a"].warnings == ["model said", "Refinement classification was missing and was set to uncertain.", "Dimension 1 type `zzz` is not allowed and was set to unknown.", "Suspicious diameter symbol in raw_text: `#1`."]
    assert got["b"].warnings == ["Refinement classification was missing and was set to uncertain.", "Refinement warnings were not a list and were reset.", "Refinement confidence was missing and was set to 0.0.", "Refinement dimension was not an object and was reset.", "Refinement metadata was not an object and was reset."]
    assert (got["c"].classification, got["c"].confidence, got["c"].warnings, got["c"].status) == ("note", 1.0, [], "completed") and got["d"].confidence == 0.0


def test_quantities_that_are_texts_stay_texts(spark):
    answer = {"dimensions": [{"raw_text": "1", "quantity": q} for q in (4.0, "4.0", 1e1, "1e1", 4, " X ", "", 2.5)]}
    made = parse.products(spark.createDataFrame([("a", json.dumps(answer))], "file_name string, raw_response string"))
    assert [r.k_quantity for r in evidence.full_page_candidates(made, ["file_name"]).orderBy("candidate_id").collect()] == ["4", "4.0", "10", "1e1", "4", "x", None, "2.5"]


def test_safe_merges(spark):
    products = spark.createDataFrame([("f", "scale", "2.1"), ("f", "sheet", None), ("g", "scale", "1:1"), ("h", "scale", None), ("i", "size", "N/A"), ("j", "sheet", " ")], "file string, field string, value string")
    base = {"status": "completed", "classification": "metadata", "confidence": 0.95, "ocr_text_supported": True, "local_context": "title_block", "visible_label": None, "target_id": "t", "ocr_text": "x"}
    rows = [
        ("f", 1, "Drawing Scale", "2:1", {}), ("f", 2, "sheet", "006", {"local_context": "unknown"}), ("g", 1, "scale", "2:1", {}), ("h", 1, "scale", "2.1", {"confidence": 0.9}), ("h", 2, "scale", "2:1", {"confidence": 0.9}),
        ("i", 1, "size", "A3", {}), ("j", 1, "sheet no.", "1", {"ocr_text_supported": False}), ("j", 2, "sheet no.", "2", {"classification": "note"}), ("j", 3, "sheet no.", "3", {"status": "failed"}), ("j", 4, "unknown field", "4", {}),
        ("j", 5, "sheet no.", "N/A", {}), ("j", 6, "sheet no.", "6", {"ocr_text_supported": None, "local_context": "unknown", "visible_label": "SHEET"}), ("j", 7, "sheet", "7", {}),
    ]
    names = ["status", "classification", "confidence", "ocr_text_supported", "local_context", "visible_label", "target_id", "ocr_text"]
    refs = spark.createDataFrame([(f, o, n, v, v.lower(), *[{**base, **more}[k] for k in names]) for f, o, n, v, more in rows], "file string, ord int, field string, value string, visual_text string, status string, classification string, confidence double, ocr_text_supported boolean, local_context string, visible_label string, target_id string, ocr_text string")
    merges = review.safe_merges(products, refs, ["file"])
    assert sorted((r.file, r.ord, r.value, r.reason == review.MENDED) for r in merges.collect()) == [("f", 1, "2:1", True), ("h", 1, "2.1", False), ("h", 2, "2:1", True), ("j", 6, "6", False)]
    got = {(r.file, r.field): r.value for r in review.merged(products, merges, ["file"]).collect()}
    assert got == {("f", "scale"): "2:1", ("f", "sheet"): None, ("g", "scale"): "1:1", ("h", "scale"): "2:1", ("i", "size"): "N/A", ("j", "sheet"): "6"}


def test_coverage_and_review_items(spark):
    product = {"scale": "2.1", "dimensions": [{"raw_text": "(x2) #5", "value": 5}], "dimension_tables": [{"rows": [{"label": "A", "values": [800]}]}, {"columns": ["x"], "rows": [{"values": [70]}, {"values": [71]}]}]}
    products = parse.products(spark.createDataFrame([("a.pdf", json.dumps(product))], "file_name string, raw_response string"), ("file_name",))
    keys = review.product_coverage(products, ["file_name"]).first()
    assert {"5", "Ø5", "(x2)Ø5"} <= set(keys.dimension_keys) and keys.table_keys == ["800"]
    dim = lambda v, **k: {"classification": "dimension", "is_product_dimension": True, "dimension": {"raw_text": v, "value": v, "type": "linear"}, "confidence": 0.9, "visual_text": v, "local_context": "note", **k}
    answers = [dim("800"), dim("5"), dim("950"), dim("960", confidence=0.1), dim("970", visual_text="9"), dim("980", dimension={"raw_text": "980", "value": "980", "type": "pattern"}), {"classification": "metadata", "metadata": {"field": "Scale", "value": "2:1"}}, {"classification": "metadata", "metadata": {"field": "sheet", "value": "1"}}, {"classification": "note"}, "broken"]
    rows = [("a.pdf", i, f"t{i}", json.dumps(a) if isinstance(a, dict) else a) for i, a in enumerate(answers)] + [("a.pdf", 10, "t10", None)]
    texts = {i: a["dimension"]["raw_text"] for i, a in enumerate(answers) if isinstance(a, dict) and a.get("dimension")}
    refs = parse.refinements(spark.createDataFrame(rows, "file_name string, ord int, target_id string, raw_response string"), ("file_name", "ord", "target_id"))
    refs = refs.withColumn("ocr_text", F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("ord"))).withColumn("status", F.when(F.col("ord") == 10, "failed").otherwise(F.col("status")))
    judged = review.judged(refs, products, ["file_name"])
    s = review.refinement_summary(judged, ["file_name"]).first()
    assert (s.targets, s.dimensions, s.metadata, s.notes, s.uncertain, s.failed, s.covered_by_dimensions, s.covered_by_dimension_tables, s.new_dimension_candidates, s.metadata_review_candidates) == (11, 6, 2, 1, 1, 1, 1, 1, 4, 2)
    items = sorted((r.ord.ord, r.list, r.kind, r.reason) for r in review.review_items(judged, ["file_name"]).collect())
    why = review.REASONS
    assert items == [(2, "merge_ready", "dimension", why["merge_ready:confident"]), (3, "needs_review", "dimension", why["needs_review:low_confidence"]), (4, "needs_review", "dimension", why["needs_review:text_conflict"]), (5, "needs_review", "dimension", why["needs_review:unsafe"]), (6, "needs_review", "metadata", why["needs_review:conflict"]), (7, "needs_review", "metadata", why["needs_review:missing_in_product"])]


def test_ocr_candidates_and_targets(spark):
    texts = ["#1,83", "ProductName", "1.02", "5STUB|7", "(x7) 1,02", "4", "12", "12"]
    rows = [("a", 1, i + 1, [[0.0, 0.0], [20.0, 10.0]], t, 0.5 if i == 7 else 0.9, "a#page=1", "e", 0.1) for i, t in enumerate(texts)] + [("a", 1, 9, [[0.0]], "3", 0.9, "", "e", 0.1), ("a", 1, 10, [[0.0, 0.0], [0.0, 9.0]], "33", 0.9, "", "e", 0.1), ("b", 1, 1, [[0.0, 0.0], [20.0, 10.0]], "1.02", 0.9, "", "e", 0.1)]
    read = spark.createDataFrame(rows, "file_name string, page int, ordinal int, polygon array<array<double>>, text string, confidence double, source_ref string, engine string, elapsed double")
    blocks = ocr.blocks(read, ["file_name"])
    assert blocks.count() == 10 and blocks.first().id == "page_001_ocr_001"
    answer = {"dimensions": [{"raw_text": "1,83", "value": 1.83}, {"raw_text": "(x7) #1,02"}]}
    products = parse.products(spark.createDataFrame([("a", json.dumps(answer))], "file_name string, raw_response string"), ("file_name",))
    got = ocr.candidates(blocks, products, ["file_name"])
    assert {(r.file_name, r.text, r.full_page_status) for r in got.collect()} == {("a", "#1,83", "supported"), ("a", "1.02", "supported"), ("a", "(x7) 1,02", "supported"), ("a", "4", "not_found_in_full_page"), ("a", "12", "not_found_in_full_page"), ("a", "33", "not_found_in_full_page"), ("b", "1.02", "not_found_in_full_page")}
    images = spark.createDataFrame([("a", 1, 500, 300, "a#page=1")], "file_name string, page int, image_width int, image_height int, source_ref string")
    crops = ocr.targets(got.drop("source_ref"), images, ["file_name"]).collect()
    assert [(r.id, r.text, tuple(r.bbox), tuple(r.ocr_bbox)) for r in crops] == [("page_001_ocr_target_001", "12", (0, 0, 384, 300), (0, 0, 20, 10))]


def test_extraction_runs(spark):
    files_ = spark.createDataFrame([("in/A_B1_Drawing.pdf",), ("in/c.png",)], "path string")
    rendered = spark.createDataFrame([("in/A_B1_Drawing.pdf", 1, "p1.png"), ("in/A_B1_Drawing.pdf", 2, "p2.png")], "path string, page int, image_path string")
    images = extract.page_images(files_, rendered)
    assert sorted((r.page, r.image_path, r.source_ref) for r in images.collect()) == [(1, "in/c.png", "in/c.png#page=1"), (1, "p1.png", "in/A_B1_Drawing.pdf#page=1"), (2, "p2.png", "in/A_B1_Drawing.pdf#page=2")]
    asked = extract.page_requests(images)
    assert all("A_B1_Drawing.pdf" in r.prompt or "c.png" in r.prompt for r in asked.collect())
    given = spark.createDataFrame([("in/A_B1_Drawing.pdf#page=1", "completed", '{"warnings": []}', None, True), ("in/c.png#page=1", "failed", "text", "down", False)], "request_id string, status string, raw_response string, error string, truncated boolean")
    got = {r.request_id: r for r in extract.product_runs(asked, given).collect()}
    one_, two, three = (got[k] for k in ("in/A_B1_Drawing.pdf#page=1", "in/A_B1_Drawing.pdf#page=2", "in/c.png#page=1"))
    assert (one_.status, one_.validation_warnings, one_.warnings) == ("validation_failed", [extract.TRUNCATED], [extract.TRUNCATED])
    assert (two.status, three.status, three.error, three.raw_response, three.validation_warnings) == ("not_run", "failed", "down", "text", [])
    first = {r.path: r.warnings for r in extract.first_pages(extract.product_runs(asked, given), "ollama").collect()}
    assert first["in/c.png"] == ["ollama extraction failed: down"] and len(first) == 2
    targets = spark.createDataFrame([("in/c.png", "t1", 1, (0, 1, 2, 3), "5", "numeric_candidate", "x.png")], "path string, id string, page int, bbox struct<x:int,y:int,width:int,height:int>, text string, classification string, image_path string")
    ask = extract.target_requests(targets)
    assert "x=0, y=1, width=2, height=3" in ask.first().prompt
    runs = extract.refinement_runs(ask, spark.createDataFrame([("in/c.png#t1", "completed", '{"classification": "note", "confidence": 1}', None, False)], given.schema)).first()
    assert (runs.target_id, runs.status, runs.classification) == ("t1", "completed", "note")
    assert extract.resolved_model("ollama", None) == "moondream" and extract.resolved_model("anthropic", None) is None and extract.resolved_model("none", "x") is None


def test_paths_settings_and_pdf(spark, tmp_path, monkeypatch):
    p = F.col("p")
    df = spark.createDataFrame([("in/DEMO_AB12_Technical_Drawing_page-0001.pdf",)], "p string")
    got = df.select(paths.output_name(p).alias("a"), paths.page_raw_response("i", paths.output_name(p), F.lit(1)).alias("b"), paths.page_raw_response("i", paths.output_name(p), F.lit(2)).alias("c"), paths.part_raw_response("i", paths.output_name(p), F.lit("t1")).alias("d"), paths.now_utc().alias("e")).first()
    assert tuple(got)[:4] == ("demo_ab12", "i/demo_ab12.raw_response.txt", "i/demo_ab12_page_002.raw_response.txt", "i/demo_ab12_t1.raw_response.txt") and got.e.endswith("+00:00")
    (tmp_path / ".env").write_text("# no\n\nSHEETLAKE_MODEL = 'm'\nSHEETLAKE_EXTRACTOR=\" OLLAMA \"\nodd\n")
    monkeypatch.setenv("SHEETLAKE_MODEL", "kept")
    monkeypatch.delenv("SHEETLAKE_EXTRACTOR", raising=False)
    config.load_env(tmp_path / ".env")
    assert config.read() == config.Config("ollama", "kept") and [config.think(x) for x in ("true", "false", "low", None)] == [True, False, "low", None]
    __import__("os").environ.pop("SHEETLAKE_EXTRACTOR")  # the file set it; monkeypatch would bring it back at the end

    def render(content, dpi):
        return [(100.0, 100.0, b"x" if dpi else None), (200.0, 100.0, None)] if content == b"ok" else 1 / 0

    made = pdf.pages(spark.createDataFrame([("a", b"ok"), ("b", b"no")], "path string, content binary"), render).collect()
    assert [(r.path, r.page, r.width, r.error is None) for r in made] == [("a", 1, 100.0, True), ("a", 2, 200.0, True), ("b", None, None, False)]


def test_registry_order_and_messages(spark):
    files_ = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2")], "path string, fingerprint string")
    tried = spark.createDataFrame([("a", "1", "failed"), ("d", "2", "completed")], "path string, fingerprint string, status string")
    assert [r.path for r in registry.next_equal(files_, tried).collect()] == ["b"]
    # a batch of very many partitions stays before the next one
    early = registry.entries(spark.range(400, numPartitions=400).select(F.lit("f").alias("fingerprint"), F.lit("completed").alias("status"), F.lit("old").alias("result_path")), 0)
    late = registry.entries(spark.createDataFrame([("f", "completed", "new")], "fingerprint string, status string, result_path string"), 1)
    log = early.unionByName(late)
    assert registry.latest_completed(log).first().result_path == "new"
    assert [r.message for r in registry.skip_messages(spark.createDataFrame([("p", "f"), ("q", "g")], "path string, fingerprint string"), log).collect()] == ["SKIP p (already completed) -> new"]
    entry = registry.failed_entries(spark.createDataFrame([("p", "n", "f", "e")], "path string, filename string, fingerprint string, error string")).first()
    assert (entry.input_path, entry.status, entry.error) == ("p", "failed", "e")


def test_files_and_json(spark, tmp_path):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 4961, 3508)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 6
    (tmp_path / "sub").mkdir()
    for name, data in (("a.PNG", png), ("sub/b.jpg", jpg), ("c.jpg", b"\xff\xd8\xff\xd9"), ("d.txt", b"x"), ("e.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r for r in files.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.PNG", "b.jpg", "c.jpg", "e.pdf"} and tuple(got["a.PNG"].image) == (4961, 3508) and tuple(got["b.jpg"].image) == (40, 30) and got["c.jpg"].image is None
    assert got["e.pdf"].fingerprint.startswith("sha256:")
    data = {"t": "°C", "rows": [["x" * 150, 1], ["y" * 500]], "e": {}, "n": None}
    text = one(spark, json.dumps(data), json_text.compact_json)
    assert json.loads(text) == data and "°C" in text and text.endswith("}\n") and f'["{"x" * 150}", 1]' in text


class Stub:
    """A model server whose answers are given beforehand: (status, body, headers) one after the other for each prompt."""

    def __init__(self, answers):
        import http.server
        import threading

        stub = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                prompt = body.get("prompt") or body["messages"][0]["content"][1]["text"]
                stub.asked.append((prompt, body))
                queue = answers[prompt]
                code, text, headers = queue.pop(0) if len(queue) > 1 else queue[0]
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *a):
                pass

        self.asked = []
        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_endpoints(spark, monkeypatch):
    ok = json.dumps({"content": [{"type": "text", "text": " a "}, {"type": "x"}, {"type": "text", "text": "b"}], "stop_reason": "max_tokens", "response": "local", "done_reason": "stop"})
    answers = {
        "ok": [(200, ok, {})], "busy": [(429, "slow down", {"Retry-After": "0"}), (200, ok, {})], "down": [(500, "broken", {})], "bad": [(400, "no such model", {})], "empty": [(404, "", {})], "json": [(200, "{oops", {})], "none": [(200, '{"content": [], "é": 1}', {})],
    }
    names = sorted(answers)
    monkeypatch.setenv("STUB_KEY", "k")
    monkeypatch.setitem(spark.sparkContext.environment, "STUB_KEY", "k")  # for the workers
    ask_rows = spark.createDataFrame([(n, n, b"img", "in/p.JPG") for n in names], "request_id string, prompt string, image binary, image_path string").coalesce(1)
    stub = Stub(answers)
    made = providers.respond(ask_rows, providers.hosted_messages(stub.url, "m", "STUB_KEY"), lanes=1, per_second=50, tries=2, pause=0.01)
    got = {r.request_id: (r.status, r.raw_response, r.error, r.truncated) for r in made.collect()}
    assert got["ok"] == got["busy"] == ("completed", "a \nb", None, True)
    assert got["down"] == ("failed", "broken", "HTTP 500: broken", False) and got["bad"] == ("failed", "no such model", "HTTP 400: no such model", False)
    assert got["empty"] == ("failed", None, "HTTP 404: Not Found", False)
    assert got["json"][:2] == ("failed", None) and got["json"][2].startswith("Expecting property name") and got["none"] == ("failed", '{"content": [], "é": 1}', providers.NO_TEXT, False)
    tries = [p for p, _ in stub.asked]
    assert {n: tries.count(n) for n in names} == {"bad": 1, "busy": 2, "down": 2, "empty": 1, "json": 1, "none": 1, "ok": 1}
    assert stub.asked[0][1]["messages"][0]["content"][0]["source"]["media_type"] == "image/jpeg"
    local = providers.local_generate(Stub({**answers, "none": [(200, '{"response": 5}', {})]}).url, "m", "low")
    assert local("ok", b"x") == providers.Answer("completed", "local") and local("none", b"x")[:3] == ("failed", '{"response": 5}', providers.NO_RESPONSE)
    assert local("down", b"x")[:3] == ("failed", None, "HTTP Error 500: Internal Server Error") and local("down", b"x").again
    assert not providers.local_generate("http://127.0.0.1:1/", "m")("x", b"").raw_response
    monkeypatch.delenv("STUB_KEY")
    assert providers.hosted_messages("http://x", "m", "STUB_KEY")("p", b"").error == "STUB_KEY is not set."
    monkeypatch.setenv("STUB_KEY", "k")
    assert providers.hosted_messages("http://x", None, "STUB_KEY")("p", b"").error == providers.NO_MODEL
    assert [providers.media_type(n) for n in ("a.png", "a.JPEG", "a.gif", "a.webp", "a.tif", "a")] == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/png", "image/png"]
    boom = providers.respond(ask_rows.limit(1), lambda *a: 1 / 0).first()
    assert (boom.status, boom.error) == ("failed", "ZeroDivisionError: division by zero")
    with pytest.raises(ValueError):
        providers.respond(ask_rows, local, per_second=1)


def test_recorded_calls_are_never_repeated(spark, tmp_path):
    """A batch is killed half way; done again, it asks only for what the ledger lacks."""
    from sheetlake import command

    source, marks = tmp_path / "in", tmp_path / "marks"
    source.mkdir()
    marks.mkdir()
    for i in range(9):
        (source / f"part{i}.png").write_bytes(b"%d" % i)

    def asking(dies):
        def ask(prompt, image, name):
            import os
            import uuid

            if dies and len(os.listdir(marks)) >= 5:
                os._exit(3)  # as a lost executor
            (marks / f"{image.decode()}-{uuid.uuid4().hex}").write_text("")
            return providers.Answer("completed", json.dumps({"product_name": image.decode()}))
        return ask

    how = {"wave": 2, "lanes": 1}
    with pytest.raises(Exception):
        command.process(spark, str(source), str(tmp_path / "out"), ask=asking(True), extractor="ollama", calls=how)
    recorded = {r.raw_response for r in spark.read.parquet(str(tmp_path / "out/work/batch=0/part=0/calls")).collect()}
    assert 0 < len(recorded) < 9 and not (tmp_path / "out/registry").exists()
    counts = command.process(spark, str(source), str(tmp_path / "out"), ask=asking(False), extractor="ollama", calls=how)
    assert counts == {"found": 9, "processed": 9, "skipped": 0, "failed": 0}
    asked = [m.name.split("-")[0] for m in marks.iterdir()]
    assert all(asked.count(json.loads(r)["product_name"]) == 1 for r in recorded) and set(asked) == {str(i) for i in range(9)}
    assert {json.loads(r.json)["product_name"] for r in spark.read.parquet(str(tmp_path / "out/products")).collect()} == {str(i) for i in range(9)}


def test_pages_tiles_and_targets_are_chained(spark, tmp_path):
    import struct

    from sheetlake import command

    source = tmp_path / "in"
    source.mkdir()
    for name in ("DEMO_AB12.png", "x/DEMO_AB12.png"):
        (source / name).parent.mkdir(exist_ok=True)
        (source / name).write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1400, 1000) + name.encode())
    (source / "x/DEMO_AB12.png").unlink()
    page = {"product_name": "Relay", "scale": "2.1", "dimensions": [{"raw_text": "5", "value": 5, "type": "linear", "label": "A"}], "tables": [{"columns": ["P", "Q"], "rows": [{"values": [1, "a"]}, {"values": [2, "b"]}]}], "notes": ["n"]}
    tile = {"dimensions": [{"raw_text": "5", "value": 5, "type": "linear", "label": "A"}, {"raw_text": "9", "value": "9", "type": "linear", "label": "B"}]}
    target = {"classification": "dimension", "is_product_dimension": True, "confidence": 0.95, "raw_text": "77", "visual_text": "77", "ocr_text_supported": True, "local_context": "drawing_view", "dimension": {"raw_text": "77", "value": "77", "type": "linear"}, "warnings": []}
    scale = {"classification": "metadata", "confidence": 0.9, "visual_text": "2:1", "metadata": {"field": "Scale", "value": "2:1"}}
    name = "DEMO_AB12.png"
    lines = [{"file_name": name, "raw_response": json.dumps(page)}]
    lines += [{"file_name": name, "part_id": f"page_001_tile_{i:03d}", "raw_response": json.dumps(tile)} for i in (1, 2)]
    lines += [{"file_name": name, "part_id": "page_001_ocr_target_001", "raw_response": json.dumps(target)}, {"file_name": name, "part_id": "page_001_ocr_target_002", "raw_response": json.dumps(scale)}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    box = [[10.0, 10.0], [40.0, 30.0]]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"file_name": name, "ordinal": i, "polygon": box, "text": t, "confidence": 0.9, "engine": "e"}) for i, t in enumerate(("77", "2:1", "5", "word"), 1)))
    out = str(tmp_path / "out")
    argv = ["process", str(source), "--outputs", out, "--responses", str(tmp_path / "r.jsonl"), "--texts", str(tmp_path / "t.jsonl"), "--ocr", "--extract-crops", "--documents"]
    assert command.main(argv) == 0
    review_ = spark.read.parquet(f"{out}/reviews").first()
    assert (review_.counts.dimensions, review_.counts.raw_ocr_blocks, review_.counts.ocr_candidates, review_.counts.ocr_target_crops, review_.counts.ocr_target_refinements, review_.counts.tile_extractions) == (1, 4, 3, 2, 2, 2)
    assert [json.loads(i)["target_id"] for i in review_.review.merge_ready] == ["page_001_ocr_target_001"] and [json.loads(i)["reason"] for i in review_.review.needs_review] == [review.REASONS["needs_review:conflict"]]
    only, groups = [json.loads(i) for i in review_.tile_review.tile_only_candidates], [json.loads(i) for i in review_.tile_review.duplicate_candidate_groups]
    assert {c["raw_text"] for c in only} == {"9"} and {(g["k_value"], g["members"]) for g in groups} == {("5", 2), ("9", 2)}
    audit = spark.read.parquet(f"{out}/audits").first()
    assert (len(audit.tiles), len(audit.tile_extractions), len(audit.ocr_target_refinements), len(audit.regions), audit.tile_summary.full_page_supported_candidates, audit.refinement_summary.new_dimension_candidates) == (2, 2, 2, 1, 2, 1)
    docs = tmp_path / "out/documents"
    files_ = {str(p.relative_to(docs)) for p in docs.rglob("*") if p.is_file()}
    responses = {"internal/demo_ab12.raw_response.txt"} | {f"internal/tile_responses/demo_ab12_page_001_tile_{i:03d}.raw_response.txt" for i in (1, 2)} | {f"internal/ocr_target_responses/demo_ab12_page_001_ocr_target_{i:03d}.raw_response.txt" for i in (1, 2)}
    assert files_ == responses | {"products/demo_ab12.json", "internal/demo_ab12.internal.json", "internal/demo_ab12.tile_summary.json", "internal/reviews/demo_ab12.review.json", "internal/demo_ab12.vlm_prompt.txt"}
    made = json.loads((docs / "products/demo_ab12.json").read_text())
    assert made["tables"] == [{"type": "unknown", "title": None, "context": None, "columns": ["P", "Q"], "rows": [[1, "a"], [2, "b"]]}] and made["notes"] == ["n"] and made["dimensions"][0]["value"] == 5 and "type" not in made
    assert json.loads((docs / "internal/demo_ab12.internal.json").read_text())["tiles"][0]["tile_id"] == "page_001_tile_001"
    assert spark.read.parquet(f"{out}/registry").first().result_path == f"{out}/documents/products/demo_ab12.json"


def test_warnings_of_steps_that_are_left_out(spark, tmp_path):
    from sheetlake import command

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"1")
    (tmp_path / "t.jsonl").write_text("")
    out = str(tmp_path / "out")
    command.process(spark, str(tmp_path / "in"), out, extract_crops=True, texts=str(tmp_path / "t.jsonl"))
    from sheetlake.operators import chain

    assert spark.read.parquet(f"{out}/products").first().warnings == [parse.PLACEHOLDER, chain.CROPS_SKIPPED, chain.TARGETS_SKIPPED]
    assert command.process(spark, str(tmp_path / "nowhere"), out + "2") == {"found": 0, "processed": 0, "skipped": 0, "failed": 0}


def test_documents_are_visible_only_when_all_are_written(spark, tmp_path):
    from sheetlake.sources import outputs

    root = str(tmp_path / "docs")
    rows = [("a/x.txt", "old", "b"), ("a/x.txt", "new", "C"), ("a/x.txt", "older", "A"), ("b.txt", "é", "p"), ("c.txt", None, "p")]
    texts = spark.createDataFrame(rows, "file string, text string, path string")
    assert outputs.write(outputs.winners(texts), root) == 2
    found = lambda: {str(p.relative_to(root)): p.read_text() for p in (tmp_path / "docs").rglob("*") if p.is_file()}
    assert found() == {"a/x.txt": "new", "b.txt": "é"}
    broken = spark.createDataFrame([("a/x.txt", "newer"), ("d.txt", "d"), ("\0", "no such name")], "file string, text string")
    with pytest.raises(Exception):
        outputs.write(broken, root)
    assert found() == {"a/x.txt": "new", "b.txt": "é"} and sorted(p.name for p in (tmp_path / "docs").iterdir()) == ["a", "b.txt"]


def test_jpeg_headers_with_stray_bytes(spark):
    import struct

    head = b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 6
    for before in (b"", b"\x00\x11", b"\xff\xd9", b"\xff\xff\xff\xd8ab", b"\xff\xe0\x00\x04ab", b"\x00\xff"):
        assert files._jpeg(b"\xff\xd8" + before + head) == {"width": 40, "height": 30}
    for broken in (b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\x00\x01" + head, b"\xff\xd8" + head[:8], b"\xff\xd8\xff\xe0\x00\xff" + head, b"\x00" + head):
        assert files._jpeg(broken) is None


def test_incremental_stream(spark, tmp_path):
    from sheetlake.streaming import incremental

    source, reg = tmp_path / "in", str(tmp_path / "registry")
    for n, rows in enumerate([[("a", "1"), ("b", "1")], [("c", "2"), ("d", "1")]]):
        spark.createDataFrame(rows, "path string, fingerprint string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, fingerprint string").parquet(str(source))
        q = incremental.process_batches(stream, reg, lambda df: df.withColumn("status", F.lit("completed")), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted((r.path, r.fingerprint) for r in spark.read.parquet(reg).collect()) == [("a", "1"), ("c", "2")]


def test_command(spark, tmp_path, capsys):
    from sheetlake import command

    source, outputs = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, data in (("a.png", b"1"), ("b.PDF", b"2"), ("c.jpg", b"1"), ("d.pdf", b"4"), ("e.txt", b"5")):
        (source / name).write_bytes(data)
    recorded = tmp_path / "responses.jsonl"
    answers = [{"file_name": "a.png", "raw_response": '{"product_name": "Relay", "notes": ["x"], "dimensions": [{"value": "5"}, 3]}'}, {"file_name": "b.PDF", "raw_response": None, "error": "down"}]
    recorded.write_text("\n".join(map(json.dumps, answers)))
    run = lambda *more: command.main(["process", str(source), "--outputs", outputs, "--responses", str(recorded), *more])
    said = lambda: dict(line.split(": ") for line in capsys.readouterr().out.split("\n") if ": " in line)
    assert run() == 1 and said() == {"found": "4", "processed": "2", "skipped": "1", "failed": "1"}
    products = {r.file_name: r for r in spark.read.parquet(f"{outputs}/products").collect()}
    assert products["a.png"].status == "validation_failed" and json.loads(products["a.png"].json)["product_name"] == "Relay"
    assert products["d.pdf"].status == "not_run" and products["d.pdf"].warnings == [parse.PLACEHOLDER] and "c.jpg" not in products
    review_ = {r["product"].source_file: r for r in spark.read.parquet(f"{outputs}/reviews").collect()}
    assert review_["a.png"].counts.dimensions == 1 and review_["a.png"].counts.notes == 1 and review_["a.png"].counts.pages == 0
    recorded.write_text(json.dumps({"file_name": "b.PDF", "raw_response": "{}", "error": None}))
    assert run() == 0 and said() == {"found": "4", "processed": "1", "skipped": "3", "failed": "0"}
    assert command.main(["status", "--outputs", outputs]) == 0 and said() == {"entries": "4", "completed": "3", "failed": "1"}
    audit = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{outputs}/audits").collect()}
    assert audit["a.png"].document.original_filename == "a.png" and len(audit["a.png"].regions) == 1 and audit["d.pdf"].extraction.status == "not_run"
    # of equal files the next one is tried where the first fails
    recorded.write_text("\n".join(json.dumps({"file_name": n, "raw_response": r, "error": None}) for n, r in (("a.png", None), ("c.jpg", "{}"))))
    command.process(spark, str(source), outputs + "2", str(recorded))
    assert {(r.filename, r.status) for r in spark.read.parquet(f"{outputs}2/registry").collect()} == {("a.png", "failed"), ("c.jpg", "completed"), ("b.PDF", "completed"), ("d.pdf", "completed")}
    # a model that is asked instead
    counts = command.process(spark, str(source), outputs + "3", ask=lambda prompt, image, name: providers.Answer("completed", '{"product_name": "M"}') if image == b"1" else providers.Answer("failed"), crops=True)
    assert counts == {"found": 4, "processed": 1, "skipped": 1, "failed": 2} and spark.read.parquet(f"{outputs}3/tiles").count() == 0
    assert command.parser().parse_args(["process", "--extractor", "ollama", "--ollama-think", "low", "--generate-crops", "--retry-failed"]).extractor == "ollama"
    assert command.endpoint("none", None, None) is None and callable(command.endpoint("ollama", None, "true"))
    assert callable(command.endpoint("anthropic", None, None))
    with pytest.raises(ValueError):
        command.endpoint("other", None, None)


def test_reviews_list_evidence(spark):
    from sheetlake.operators import documents

    answers = spark.createDataFrame([("p", "a.png", '{"product_name": "Relay"}'), ("q", "b.png", "{}")], "path string, file_name string, raw_response string")
    rows = spark.createDataFrame([("p", 2, "scale"), ("p", 1, "sheet")], "path string, ord int, field string")
    made = {r.path: r for r in documents.reviews(parse.products(answers, ("path", "file_name")), {"metadata_merges": rows, "needs_review": rows}).collect()}
    assert [json.loads(x)["field"] for x in made["p"].review.applied_merges] == ["sheet", "scale"] and made["p"].counts.metadata_merges == 2
    assert made["q"].review.needs_review == [] and made["q"].counts.metadata_merges == 0 and made["q"].extraction.model is None


def test_answers_are_decoded_by_columns(spark):
    """Values of every kind in every place; equal texts are read once, and each broken one has its own error."""
    import pyarrow as pa
    from sheetlake.sources import answers as A

    calls = []

    def counted(values):
        calls.append(len(values))
        return A.leaf[0](values)

    spec = A.entry(title=(counted, A.LEAF), rows=A.listed(A.entry(labelled=("label", A.given), values=A.listed(A.leaf))), notes=A.list_text, kind=("rows", A.raw))
    texts = ['{"title": " a ", "rows": [{"values": ["1", 2, null, "n/a"]}, 5, {"label": null}], "notes": [1]}', "[1]", '{"rows": null, "notes": 3}', "{", None, '{"title": 1.50, "rows": {}}', '{"title": ' + "9" * 5000 + "}"]
    decode = A.decoder(spec).func
    got = decode(pa.array(texts)).to_pylist()
    none = {"k": None, "items": []}
    rows = [{"object": True, "labelled": False, "values": {"k": "list", "items": [{"k": "text", "t": "1"}, {"k": "whole", "t": "2"}, None, None]}}, {"object": False, "labelled": None, "values": None}, {"object": True, "labelled": False, "values": none}]
    assert got[0] == {"error": None, "v": {"object": True, "title": {"k": "text", "t": "a"}, "rows": {"k": "list", "items": rows}, "notes": {"k": "list", "t": "[1]"}, "kind": {"k": "json", "t": '[{"values":["1",2,null,"n/a"]},5,{"label":null}]'}}}
    assert got[2]["v"]["notes"] == {"k": "other", "t": "[]"} and got[2]["v"]["rows"] == {"k": "null", "items": []} and got[2]["v"]["kind"] == {"k": "null", "t": "null"}
    assert [g["error"] for g in got[3:6]] == [A.NOTHING, A.NOTHING, None] and got[1]["error"] == A.NOTHING and "4300 digits" in got[6]["error"] and [got[i]["v"] for i in (1, 3, 4, 6)] == [None] * 4
    assert got[5]["v"]["title"] == {"k": "float", "t": "1.5"} and got[5]["v"]["rows"] == {"k": "other", "items": []}
    calls.clear()
    assert decode(pa.array([texts[0], texts[5]] * 500)).to_pylist() == [got[0], got[5]] * 500 and calls == [2]
