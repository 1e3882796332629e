import math

import pytest
from pyspark.sql import functions as F

from chashma.functions import composed as C
from chashma.functions import text as T
from chashma.operators import aggregate as A
from chashma.operators import relate as R
from chashma.operators import rules as L
from chashma.operators import sampling as W
from chashma.operators import typos as Y
from chashma.sources import files as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (0, 1, 2, 3)], "g string, v long")
    r = A.exact_quantiles(df, ["g"], "v").first()
    assert math.isclose(r.p90, 2.7) and math.isclose(r.p50, 1.5)
    assert A.nearest_rank(df, ["g"], "v").first().p90 == 3


def test_allocation(spark):
    strata = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "part int, size long")
    assert {r.part: r.quota for r in W.allocate(strata, "part", "size", 4).collect()} == {1: 2, 2: 1, 3: 1}
    floored = {r.part: r.quota for r in W.allocate(spark.createDataFrame([(1, 1000), (2, 1), (3, 1)], "part int, size long"), "part", "size", 5, least=1).collect()}
    assert floored == {1: 3, 2: 1, 3: 1}


def test_wilson(spark):
    low, high = spark.range(1).select(*A.wilson(F.lit(8), F.lit(10))).first()
    assert round(low, 3) == 0.490 and round(high, 3) == 0.943


def test_near_miss(spark):
    for other, want in (("yeki", True), ("yok", True), ("yokki", True), ("yako", False)):
        assert spark.range(1).select(T.near_miss(F.lit("yoki"), F.lit(other)).alias("x")).first().x is want
    words = spark.createDataFrame([(w,) for w in ("yoki", "yeki", "yok", "yokki", "yako", "")], "token string")
    found = {r.token for r in L.near_misses(words, words.where("token = 'yoki'")).collect()}
    assert found == {"yeki", "yok", "yokki"}


def test_variants(spark):
    found = {r.t: r.v for r in Y.with_variants(spark.createDataFrame([("sho'r",), ("ab",)], "t string"), "t", "v").collect()}
    got = found["sho'r"]
    assert {v.rule for v in got} >= {"apostrophe_drop", "apostrophe_ascii_to_backtick", "apostrophe_ascii_to_curly_left", "phonetic_sh_to_s"}
    assert len({v.corrupted for v in got}) == len(got) and all(v.corrupted != "sho'r" for v in got)
    assert {v.corrupted for v in got if v.priority == 1} == {"shor", "sho`r"}
    assert found["ab"][0].corrupted == "abb"


def test_typo_rows(spark):
    df = spark.createDataFrame([("s1", "«Salom, dunyo!»  Bugun 2024 yil."), ("s2", None), ("s3", "")], "id string, text string")
    rows = Y.typo_rows(df, "id", "text").collect()
    assert rows and {r.sentence_id for r in rows} == {"s1"} and "2024" not in {r.clean_token for r in rows}
    for r in rows:
        assert r.input != r.target and r.target[r.token_start_char : r.token_end_char] == r.correction
        assert r.input == r.target[: r.token_start_char] + r.error_word + r.target[r.token_end_char :]
    c = Y.coverage(df, Y.typo_rows(df, "id", "text"), "id", "text").first()
    assert c.eligible == c.covered == 4


def test_split(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(1000)], "g string")
    got = {r.split: r["count"] for r in Y.split_groups(groups, "g").groupBy("split").count().collect()}
    assert got == {"train": 800, "dev": 100, "test": 100}


def test_two_phase(spark):
    df = spark.createDataFrame([(i, i % 3, i % 7 == 0) for i in range(300)], "id int, part int, odd boolean")
    got = W.two_phase(df, "id", "part", 5, {"ODD": (F.col("odd"), 3)}, 10).collect()
    assert len(got) == 30 and len({r.id for r in got}) == 30
    assert all(sum(r.phase == "ESTIMATION" and r.part == p for r in got) == 5 for p in range(3))


def test_numbering(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k int")
    got = [(r.row_number, r.k) for r in W.number_rows(df, ["k"]).orderBy("row_number").collect()]
    assert got == [(i + 1, i) for i in range(1000)]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (2, "w"), (3, "q")], "k int, u string")
    assert {(r.k, r.n) for r in R.with_counts(a, b, ["k"], "n").collect()} == {(1, 0), (2, 2)}
    assert {(r.k, r.side) for r in R.set_compare(a, b, "k").collect()} == {(1, "LEFT"), (2, "BOTH"), (3, "RIGHT")}
    assert R.keep_first(b, ["k"], ["u"]).where("k = 2").first().u == "w"
    with pytest.raises(ValueError):
        R.one_to_one(a, b, "k")
    docs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "d int, i int, t string")
    assert {(r.t, r.previous_text, r.next_text) for r in R.neighbours(docs, "d", "i", "t").collect()} == {("a", None, "b"), ("b", "a", None), ("c", None, None)}


def test_text_functions(spark):
    assert one(spark, T.script_label, "salom дунё") == "MIXED_LATIN_CYRILLIC" and one(spark, T.script_label, "123") == "NO_ALPHABETIC_CHARACTERS"
    assert one(spark, T.name_like, "Ali Valiyev.") and not one(spark, T.name_like, "Ali keldi va ketdi uyga")
    assert one(spark, T.short_role, "Foto: Ali") == "SHORT_CREDIT_LIKE" and one(spark, T.short_role, "Ish tugadi, hamma ketdi.") == "SHORT_SENTENCE_LIKE"
    assert one(spark, T.parse_list, "['B', \"A\"]") == ["A", "B"] and one(spark, T.parse_list, "NONE") == [] and one(spark, T.parse_list, "A|B;A") == ["A", "B"]
    assert one(spark, T.parse_float, "12.5%") == 0.125 and one(spark, T.parse_float, "nan") is None
    assert one(spark, lambda c: T.preview(c, 3), "a\n\\bcd") == "a\\n\\\\…"
    assert one(spark, T.blank_runs, "a \t b") == ["<SPACE><TAB><SPACE>"]
    spans = one(spark, lambda c: T.gap_spans(c, T.HIGH_GAPS), "u bo ldi va ko  rdi, bo ldi")
    assert [(s.start, s.stop, s.rule) for s in spans] == [(2, 6, "BO_L_PATTERN"), (12, 17, "KO_R_PATTERN"), (21, 25, "BO_L_PATTERN")]
    assert one(spark, C.normal_form, " o‘zbek “söz”  ") == "o'zbek \"söz\""
    assert one(spark, lambda c: T.human_size(c.cast("long")), "1536") == "1.50 KiB"


def test_rules(spark):
    df = spark.createDataFrame([(1, "Bugun shaharda yangi maktab ochildi va bolalar quvondi."), (2, "1, 2, 3"), (3, None), (4, "")], "id int, t string")
    got = {r.id: r.reasons_strict for r in L.select(df, "t", (L.STRICT, L.WIDE)).collect()}
    assert got[1] == [] and "HAS_DIGIT" in got[2] and got[3] == got[4] == ["EMPTY"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"text": "salom"}, {"x": 1}, 5, {"text": 7}]', encoding="utf-8")
    items = S.classify_items(S.read_small_json_array(spark, str(tmp_path / "a.json"))).orderBy("source_record_id").collect()
    assert [(r.record_type, r.text) for r in items] == [("TEXT", "salom"), ("MISSING_TEXT_FIELD", None), ("NON_DICTIONARY_RECORD", None), ("NON_STRING_TEXT", None)]
    b = S.boundaries(spark, str(tmp_path / "a.json")).first()
    assert b.starts_with_bracket and b.ends_with_bracket and b.has_bom
    df = spark.range(250).select("id", F.lit("matn\n").alias("text"))
    S.write_shards(df, str(tmp_path / "s"), "id", 100)
    assert S.manifest(spark, str(tmp_path / "s")).agg(F.sum("rows")).first()[0] == 250
    with pytest.raises(Exception):
        S.write_shards(df, str(tmp_path / "s"), "id", 100)
    before, after = (S.fingerprints(spark, str(tmp_path / "a.json")).first() for _ in range(2))
    assert before == after
    S.write_csv(df.limit(3), str(tmp_path / "c"), ["id", "text", "note"])
    assert S.read_csv(spark, str(tmp_path / "c")).columns == ["id", "text", "note"]


def test_hints_of_every_inner_end(spark):
    from chashma.operators import boundaries as B

    df = spark.createDataFrame([("Prof. A. Qodiriy\n3.5 soat... keldi.",), ("Bitta gap.",), ("belgisiz",), ("",), (None,)], "text string")
    rows = B.review_hints(df.select(F.explode(B.inner_ends(F.col("text"))).alias("right"))).collect()
    assert [r.right for r in rows] == [" A. Qodiriy\n3.5 soat... keldi.", " Qodiriy\n3.5 soat... keldi.", "5 soat... keldi.", " keldi."]
    assert ["CAPITAL_AFTER" in r.hints for r in rows] == [True, True, False, False] and "DIGIT_AFTER" in rows[2].hints


def test_boundary_hints_count_every_end(spark, monkeypatch):
    from chashma.operators import boundaries as B
    from chashma.plans import catalogue

    rows = spark.createDataFrame([("Prof. A.\nQodiriy uyga keldi.", [B.PROTECTED[0]]), ("Prof. Karimov keldi.", ["OTHER"])], "sentence_text string, boundary_flags array<string>")
    monkeypatch.setattr(catalogue, "_sentences", lambda *_: rows)
    got = {r["item"]: r["rows"] for r in catalogue.QUERIES["boundary_hints"](spark, "").collect()}
    assert got["CAPITAL_AFTER"] == 2


def hot(spark, rows=20_000, share=0.9):
    """Rows of which nine tenths are in one part, some of them in none."""
    part = F.when(F.col("id") < int(rows * share), F.lit(1)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise((F.col("id") % 7 + 2).cast("int"))
    return spark.range(rows).select("id", part.alias("part"), (F.col("id") % 11 == 0).alias("odd"), (F.col("id") * 7919 % 1000).alias("score"))


def brute_lowest(rows, k, seed="42", with_part=True):
    import hashlib

    by = {}
    for r in rows:
        told = "|".join([seed, *([str(r.part)] if with_part and r.part is not None else []), str(r.id)])
        by.setdefault(r.part, []).append((hashlib.sha256(told.encode()).hexdigest(), r.id))
    return {p: [i for _, i in sorted(x)[:k]] for p, x in by.items()}


def test_hot_part_is_cut_before_it_is_ranked(spark):
    df = hot(spark)
    scored = df.withColumn("h", W.hash_order("42", F.col("part"), F.col("id")))
    near = W.lowest(scored, ["part"], "h", F.lit(20))
    sizes = {r.part: r["count"] for r in near.groupBy("part").count().collect()}
    # what is ranked is little more than what is wanted, also of the part with nine tenths of the rows
    assert set(sizes) == {None, *range(1, 9)} and all(20 <= n <= 60 for n in sizes.values())
    want = brute_lowest(df.collect(), 20)
    for p, ids in want.items():
        got = near.where(F.col("part").eqNullSafe(F.lit(p).cast("int"))).orderBy("h").limit(20)
        assert [r.id for r in got.collect()] == ids


def test_draws_from_hot_parts(spark):
    df = hot(spark)
    quotas = df.groupBy("part").agg(F.count("*").alias("size"), F.lit(30).alias("quota")).where("part IS NOT NULL")
    got = W.draw(df, "id", "part", quotas, "size").collect()
    want = brute_lowest(df.collect(), 30)
    assert {(r.part, r.id) for r in got} == {(p, i) for p, ids in want.items() if p for i in ids}
    two = W.two_phase(df, "id", "part", 5, {"ODD": (F.col("odd"), 3)}, 12).collect()
    for p, ids in brute_lowest(df.collect(), 5).items():
        assert {r.id for r in two if r.part == p and r.phase == "ESTIMATION"} == set(ids)
    assert all(sum(r.part == p for r in two) == 12 for p in (None, *range(1, 9))) and len({r.id for r in two}) == len(two)
    assert W.balanced(df, "id", "part", 2, 100).where("part = 1").count() >= 2
    tails = W.score_tails(df, "score", "part", "id", 4).collect()
    scores = sorted((r.score, r.id) for r in df.where("part = 1").collect())
    assert {r.id for r in tails if r.part == 1 and r.tail == "LOW"} == {i for _, i in scores[:4]}
    assert {r.id for r in tails if r.part == 1 and r.tail == "HIGH"} == {i for _, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:4]}


def test_folds_of_a_hot_class(spark):
    from chashma.operators import models as M

    sizes = [r["count"] for r in M.folds(hot(spark), "id", 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes)


def test_new_parsers_and_flags(spark):
    assert [one(spark, T.parse_int, x) for x in (" 12 ", "3.0", "-7", "1.5", "x", "", None)] == [12, 3, -7, None, None, None, None]
    assert [one(spark, T.broken_spacing, x) for x in ("Noyo ning uyi", "kitob lik", "u bordi", "bog' da gul", "", None)] == [True, True, False, True, False, None]
    assert one(spark, T.format_characters, "a\u200bb\tc\x07\ufffd") == ["U+200B", "U+0007", "U+FFFD"]
    assert one(spark, lambda c: T.one_apostrophe(c, T.APOSTROPHE_MAPS["three"]), "o`z o‘z") == "o`z o'z"


def test_sweep(spark):
    df = spark.createDataFrame([("s1", "Sho'rva 2024 ab ishxona."), ("s2", None), ("s3", "")], "id string, text string")
    rows = {r.core: r for r in Y.sweep_rows(df, "id", "text").collect()}
    assert set(rows) == {"Sho'rva", "2024", "ab", "ishxona"} and not rows["2024"].eligible and rows["2024"].rule is None
    assert rows["ab"].corrupted == "abb" and all(r.corrupted != r.core for r in rows.values())
    known = spark.createDataFrame([("Sho'rva",)], "t string").select(Y.sweep_variants(F.col("t")).alias("v")).first().v
    assert {v.rule: v.corrupted for v in known} == {"apostrophe_drop": "Shorva", "apostrophe_ascii_to_backtick": "Sho`rva", "phonetic_sh": "So'rva", "drop_last": "Sho'rv", "drop_inner": "Shorva", "duplicate_inner": "Sho''rva", "swap_inner": "Sh'orva", "split_word": "Sho 'rva", "duplicate_last_char_fallback": "Sho'rvaa"}


def test_json_arrays_in_splits(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("matn [\n] , "), F.col("id").cast("string"))).alias("text"))
    S.write_json_array(df.repartition(4), str(tmp_path / "a"), "id")
    items = S.read_json_array(spark, str(tmp_path / "a"))
    told = S.classify_items(items).orderBy("source_record_id").collect()
    assert [r.source_record_id for r in told] == list(range(1000))
    assert [r.text for r in told] == [None if i % 5 == 0 else f"matn [\n] , {i}" for i in range(1000)]
    import json

    for f in (tmp_path / "a").glob("part-*"):
        assert json.loads(f.read_text()) is not None
    S.write_json_array(df.limit(0), str(tmp_path / "none"), "id")
    assert S.read_json_array(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "b.json").write_text('[\n  {"text": "bir"},\n  [1, 2],\n\n  "uch", \n  4\n]\n')
    got = S.classify_items(S.read_json_array(spark, str(tmp_path / "b.json"))).orderBy("source_record_id").collect()
    assert [(r.source_record_id, r.record_type, r.text) for r in got] == [(0, "TEXT", "bir"), (1, "NON_DICTIONARY_RECORD", None), (2, "NON_DICTIONARY_RECORD", None), (3, "NON_DICTIONARY_RECORD", None)]


def test_bom_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("\ufeffid,text\n1,\"a\nb\"\n2,\n".encode())
    got = S.read_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["id", "text"] and [tuple(r) for r in got.orderBy("id").collect()] == [("1", "a\nb"), ("2", "")]


def test_long_texts(spark):
    """Words and gaps of a text of some hundred thousand words."""
    text = "u bo ldi va  ketdi\t" * 40_000
    row = spark.createDataFrame([(text,)], "t string").select(Y.token_spans(F.col("t")).alias("w"), T.gap_spans(F.col("t"), T.HIGH_GAPS).alias("g")).first()
    assert len(row.w) == 200_000 and all(text[x.start : x.stop] == x.surface for x in row.w) and [x["index"] for x in row.w] == list(range(200_000))
    assert len(row.g) == 40_000 and all(text[x.start : x.stop] == x.fragment for x in row.g)


def test_shared_folder_of_a_cluster():
    from chashma.plans import lineage

    assert lineage.one_process("local") and lineage.one_process("local[8]") and not lineage.one_process("local-cluster[2,1,1024]") and not lineage.one_process("spark://host:7077") and not lineage.one_process("yarn")

    class Context:
        master = "yarn"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

        def getConf(self):
            return {}

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(RuntimeError):
        lineage.shared_folder(session)
