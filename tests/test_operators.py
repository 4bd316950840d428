import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexshift.functions import scalar
from lexshift.functions.running import descending_totals
from lexshift.operators import bitext, buckets, copula, features, flow, folds, joint, labels, learn, metrics, phrases, topics
from lexshift.plans.experiment import Experiment, power_set
from lexshift.sources import readers, writers


def scores(spark, text, values=None):
    rows = [(float(values[i] if values else len(text) - i), 1 if c == "+" else -1, "g") for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "score double, label int, grp string")


def test_areas(spark):
    assert metrics.auroc(scores(spark, "+-+-")).first()["auroc"] == 0.875
    assert metrics.rank_auroc(scores(spark, "+-+-")).first()["auroc"] == 0.75
    assert metrics.auroc(scores(spark, "+--+-", [1] * 5)).first()["auroc"] == 0.5
    assert metrics.auroc(scores(spark, "++")).first()["auroc"] is None
    assert metrics.aupr(scores(spark, "++--")).first()["aupr"] == 1.0
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 300), rng.integers(0, 2, 300) * 2 - 1
    best, tp, fp = {}, 0, 0
    for v in sorted(set(s), reverse=True):
        tp, fp = tp + int(((s == v) & (y > 0)).sum()), fp + int(((s == v) & (y < 0)).sum())
        best[fp] = max(best.get(fp, 0), tp)
    area, last = 0.0, (0, 0)
    for f in sorted(best):
        area, last = area + (f - last[0]) * (best[f] + last[1]) / 2, (f, best[f])
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    assert metrics.auroc(frame).first()["auroc"] == pytest.approx(area / ((y > 0).sum() * (y < 0).sum()))


def test_prf(spark):
    one = metrics.prf(spark.createDataFrame([(0.0001, 1, "a"), (-1.0, -1, "b")], "score double, label int, grp string")).first()
    assert (one["pooled_precision"], one["pooled_recall"], one["pooled_f"]) == (1.0, 0.0, 0.0)
    assert metrics.prf_by_type(spark.createDataFrame([(-1.0, -1, "b")], "score double, label int, grp string")).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.truncated(F.lit(0.81999)).alias("a"), scalar.feature_name(F.lit("a:b:1.5")).alias("b"), scalar.feature_text(F.lit("a:b:1.5")).alias("c"), scalar.feature_name(F.lit("abc")).alias("d"),
        scalar.feature_text(F.lit("x:-1e-05")).alias("e"), scalar.log0(F.lit(0.0)).alias("f"), scalar.padded(F.lit("longer"), 3).alias("g"), scalar.same_word(F.lit(None), F.lit(" ")).alias("h"),
        scalar.bm25(F.lit(1), F.lit(9), F.lit(1), F.lit(1.0), F.lit(10)).alias("i"),
    ).first()
    assert row[:8] == ("81.99", "a:b", "1.5", "abc", "-1e-05", 0.0, "longer", True)
    assert row["i"] == pytest.approx(0.01)


def test_labels(spark):
    seen = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "z", 1.0)], "fr string, en string, p double")
    assert labels.mfs(seen).filter("fr = 'a'").count() == 2
    assert {r["fr"] for r in labels.prune(seen, 1, 0.1, 0.9).collect()} == {"a", "b"} and labels.prune(seen, 1, 0.1, 0.9).count() == 2
    tokens = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", "x")], "fr string, en string")
    assert {(r["fr"], r["en"]): r["label"] for r in labels.label_new_sense(tokens, seen).collect()} == {("a", "x"): -1, ("a", "w"): 1}
    assert labels.unseen_phrases(tokens, seen).collect() == [("c", 1)]


def test_buckets(spark):
    rows = spark.createDataFrame([("f", float(v), str(v)) for v in (9, 10, 9, 10)], "name string, value double, text string")
    assert [r["boundary"] for r in buckets.boundaries(rows, 4, 2, mode="text").orderBy("boundary").collect()] == ["10", "9"]
    bounds = buckets.boundaries(rows, 8, 2)
    assert sorted(r["boundary"] for r in bounds.collect()) == [0.0, 9.0]
    assert buckets.indicators(rows.limit(0).withColumn("k", F.lit(1)), bounds, ["k"]).count() == 0


def test_even_split(spark):
    tokens = spark.createDataFrame([(f"t{i % 10}", 1 if i % 3 else -1) for i in range(200)], "fr string, label int")
    dealt = folds.even(tokens, 5)
    assert dealt.count() == 10 and {r["devfold"] for r in dealt.collect()} == {0, 1, 2, 3}
    assert all(r["testfold"] == (r["devfold"] + 1) % 4 for r in dealt.collect())


def test_even_split_by_plain_rules(spark):
    """The folds of the rules as they are stated, with numpy and lists, also where types tie, lack a label or are few."""

    def quality(left, right, n):
        shares = [s / s.sum() if s.sum() else s * 0.0 for s in (left, right)]
        middle = sum(shares) / 2
        return -10 * sum(sum(x * math.log(x / m) for x, m in zip(s, middle) if x > 0) for s in shares) / 2 - abs(left.sum() - right.sum()) / n / 10000

    def split(rows, levels):
        if levels == 0 or len(rows) < 2:
            return [rows] + [[]] * ((1 << levels) - 1)
        sides, sums = ([], []), [np.zeros(2), np.zeros(2)]
        for r in rows:
            scores = [quality(sums[0] + sizes[r] * (s == 0), sums[1] + sizes[r] * (s == 1), len(sizes)) for s in (0, 1)]
            side = 0 if not sides[0] or scores[0] >= scores[1] else 1
            sides[side].append(r)
            sums[side] = sums[side] + sizes[r]
        return [x for s in sides for x in split(s, levels - 1)]

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 700):
        sizes = rng.integers(0, 9, (n, 2)).astype(float)
        assert folds.dealt(sizes, 3).tolist() == [f for r in range(n) for f, rows in enumerate(split(list(range(n)), 3)) if r in rows]
    assert folds.even(spark.createDataFrame([], "fr string, label int"), 4).count() == 0


def test_vectors_without_a_row_for_each_indicator(spark):
    """The vectors are those of the indicators; a key's values are moved, not its indicators."""
    from tests.oracle import shuffled_rows

    rng = np.random.default_rng(6)
    values = [(k, f"x{i}", float(v)) for k in range(80) for i, v in enumerate(rng.integers(-3, 40, 3)) if rng.random() < 0.8] + [(3, "unknown", 1.0), (5, "x9", float("nan")), (6, "x9", 2.0)]
    sparse = spark.createDataFrame(values, "key long, name string, value double").withColumn("text", F.lit(""))
    rows = spark.createDataFrame([(k, "f", k % 3 - 1, ("train", "dev", "test")[k % 3]) for k in range(90)], "key long, fr string, label int, part string")
    bounds = buckets.boundaries(sparse.filter("name <> 'unknown'"), 90)
    marks = buckets.indicators(sparse, bounds, ["key"])
    space, plain = learn.Space.reached(sparse, bounds), learn.Space.of(marks)
    assert space.names == plain.names and len(space.names) > 20
    expected = {r["key"]: r["vector"] for r in plain.vectors(rows.join(features.as_maps(marks, ["key"]), "key", "left")).collect()}
    sets = learn.marked_sets(rows, sparse, bounds, space)
    assert {r["key"]: r["vector"] for s in sets.values() for r in s.collect()} == expected and len(expected) == 90
    assert {p: s.count() for p, s in sets.items()} == {"train": 30, "dev": 30, "test": 30}
    assert shuffled_rows(features.as_maps(sparse, ["key"])) < marks.count() / 4


def test_boosting_rounds_are_fitted_once(spark, monkeypatch):
    """Cut after some rounds, a boosted model is the one fitted for that many; every configuration has its own loss."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(k, "f", int(rng.random() < 0.2 + 0.15 * (k % 5)) * 2 - 1, {"x": float(k % 5), "y": float(k % 7)}) for k in range(300)], "key long, fr string, label int, features map<string,double>")
    v = learn.Space(["x", "y"]).vectors(rows).cache()
    raw = lambda m: [r[0] for r in learn.scored(m, v).orderBy("key").select("score").collect()]
    most = learn.trees({"depth": 2, "boost": 4}).fit(v)
    single = {n: learn.trees({"depth": 2, "boost": n}).fit(v) for n in (1, 2)}
    assert all(raw(learn.first_rounds(most, n)) == raw(m) for n, m in single.items())
    plain = {n: 1 - metrics.auroc(learn.scored(m, v).select("score", "label")).first()["auroc"] for n, m in {**single, 4: most}.items()}
    made = []
    best = learn.search(v, v, [{"depth": 2, "boost": n} for n in (1, 2, 4)], lambda c: made.append(c) or learn.trees(c))
    assert made == [{"depth": 2, "boost": 4}] and best.loss == min(plain.values()) == plain[best.config["boost"]]


def test_flow_of_blocks_is_maximal(spark):
    """Against plain augmenting paths, whatever the blocks; pages without the other side or without links stay whole."""
    rng = np.random.default_rng(8)

    def most(supply, demand, capacity):
        left = {("s", f): v for f, v in supply.items()} | {(e, "t"): v for e, v in demand.items()} | dict(capacity)
        total = 0.0
        while True:
            came, queue = {"s": None}, ["s"]
            for at in queue:
                for (a, b), v in left.items():
                    if a == at and b not in came and v > 1e-12:
                        came[b] = a
                        queue.append(b)
            if "t" not in came:
                return total
            path, at = [], "t"
            while came[at] is not None:
                path.append((came[at], at))
                at = came[at]
            much = min(left[x] for x in path)
            for a, b in path:
                left[a, b] -= much
                left[b, a] = left.get((b, a), 0.0) + much
            total += much

    counts = {s: [(p, f"{s}{w}", int(rng.integers(1, 9))) for p in range(12) if (s, p) != ("e", 11) for w in rng.choice(9, 6, False)] for s in "fe"}
    scores = [(f"f{i}", f"e{j}", int(rng.integers(1, 20))) for i in range(8) for j in range(9) if rng.random() < 0.5]
    f, e = (spark.createDataFrame(counts[s], "page long, word string, n long") for s in "fe")
    links = spark.createDataFrame(scores, "f string, e string, score long")
    share = lambda rows, k: {r[:2]: r[2] / sum(x[2] for x in rows if x[k] == r[k]) for r in rows}
    pf, pe, cap = share(counts["f"], 0), share(counts["e"], 0), share(scores, 0)
    for words in (1, 40, 10_000):
        got = flow.residuals(f, e, links, block_words=words).collect()
        assert {(r["page"], r["word"]) for r in got} == set(pf) and len(got) == len(pf)
        for page in range(12):
            supply, demand = ({w: v for (p, w), v in x.items() if p == page} for x in (pf, pe))
            mass = 1 + sum(r["diff"] for r in got if r["page"] == page)
            assert mass == pytest.approx(most(supply, demand, {k: v for k, v in cap.items() if k[0] in supply and k[1] in demand}), abs=1e-9)


def test_type_features_are_not_broadcast(spark):
    from lexshift.plans import catalog

    tokens = spark.createDataFrame([("a", "old"), ("a", "old"), ("b", "new"), ("c", "new")], "fr string, domain string")
    rows = spark.createDataFrame([("a", "s", "x", "1", 2.0), ("b", "s", "x", "1", 3.0)], "fr string, source string, name string, text string, value double")
    got = features.type_features(tokens, rows, ["domain"])
    assert sorted((r["domain"], r["name"], r["value"]) for r in got.collect()) == [("new", "s___type_x", 3.0), ("old", "s___type_x", 2.0), ("old", "s___type_x", 2.0)]
    frame = catalog.QUERIES["type_feature_join"](spark, "/root/testdata/sf0.001")
    for plan in (got._jdf.queryExecution().executedPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin [fr" in plan and "BroadcastHashJoin [fr" not in plan


def test_norms_do_not_count_words_again(spark):
    """The weights and their norms read the written counts: documents are not dealt out again."""
    from lexshift.operators import retrieval

    docs = spark.createDataFrame([(d, ["a", "a", "b", f"w{d}"]) for d in range(6)], "doc long, tokens array<string>")
    rows = retrieval.normalized(retrieval.weigh_bm25(retrieval.term_counts(docs)))
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(round(r["s"], 9) for r in rows.groupBy("term").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()) == [1.0] * 8


def test_bitext(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"], "0-0"), (2, ["a"], ["x"], "bad")], "sent long, src array<string>, tgt array<string>, t string").withColumn("align", bitext.parse_align(F.col("t")))
    assert {(r["f"], r["e"]) for r in bitext.word_pairs(rows.filter("sent = 1"), []).collect()} == {("a", "x"), ("b", "NULL"), ("NULL", "y")}
    assert rows.filter("sent = 2").first()["align"] == []
    old, new = (spark.createDataFrame(d, "word string, n long") for d in ([("a", 3)], [("a", 1), ("b", 7)]))
    assert bitext.overlap(old, new).first()["new_tokens"] == 1 and bitext.overlap(old, new, compat=False).first()["new_tokens"] == 7


def test_flow_is_maximal():
    sent = flow.max_flow({"a": 0.5, "b": 0.5}, {"x": 0.6, "y": 0.4}, {("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "x"): 1.0})
    assert sum(sent.values()) == pytest.approx(1.0)
    sent = flow.max_flow({"a": 0.7, "b": 0.3}, {"x": 0.5}, {("a", "x"): 0.1, ("b", "x"): 1.0})
    assert sent == pytest.approx({"a": 0.1, "b": 0.3})


def test_joint_margins():
    rng = np.random.default_rng(1)
    old, new = rng.random((4, 5)), rng.random((4, 5))
    old, new = old / old.sum(), new / new.sum()
    x = joint.solve(old, old > 0.02, new.sum(1), new.sum(0))
    assert np.abs(x.sum(1) - new.sum(1)).max() < 1e-5 and np.abs(x.sum(0) - new.sum(0)).max() < 1e-5 and x.min() >= 0


def test_joint_qp_solves_every_pair(spark):
    from lexshift.plans import catalog, tables

    sf = "/root/testdata/sf0.001"
    lines = catalog._qp(spark, sf).groupBy("grp").count()
    assert lines.agg(F.max("count")).first()[0] <= joint.LIMIT and lines.count() > 1
    pairs = {(r["fr"], r["en"]) for r in tables.tokens(spark, sf).select("fr", "en").distinct().collect()}
    got = catalog.QUERIES["joint_qp"](spark, sf).collect()
    assert pairs <= {(r["f"], r["e"]) for r in got}
    assert all(0 <= r["x"] <= 1 for r in got)


def test_joint_problems_side_by_side(spark):
    rng = np.random.default_rng(2)
    old, new = rng.random((6, 4, 3)), rng.random((6, 4, 3))
    old, new = old / old.sum((1, 2), keepdims=True), new / new.sum((1, 2), keepdims=True)
    known = old > 0.05
    x = joint.solve_all(old, known, new.sum(2), new.sum(1))
    assert all(np.array_equal(x[i], joint.solve(old[i], known[i], new[i].sum(1), new[i].sum(0))) for i in range(6))
    cells = [(g, i * 9 + j, f"e{i}", f"f{j}", i + j, i * j + 1) for g, n in (("a", 2), ("b", 3), ("c", 2)) for i in range(n) for j in range(2) if (i, j) != (1, 1)]
    got = joint.recover(spark.createDataFrame(cells, "grp string, line_no long, e string, f string, old long, new long")).toPandas()
    for grp, n in (("a", 2), ("b", 3), ("c", 2)):
        matrix = got[got["grp"] == grp].pivot(index="e", columns="f", values="x").to_numpy()
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for g, _, e, f, o, c in cells:
            if g == grp:
                a[int(e[1:]), int(f[1:])], b[int(e[1:]), int(f[1:])] = o, c
        here = b > 0
        assert np.allclose(matrix, joint.solve(a / a.sum(), here, b.sum(1) / b.sum(), b.sum(0) / b.sum()), atol=1e-12)


def test_phrase_decoding(spark):
    table = spark.createDataFrame([("a b", "x y", [0.5, 1.0, 0.5, 1.0], [4.0, 4.0]), ("a", "x", [0.5, 1.0, 0.5, 1.0], [2.0, 2.0]), ("b", "y", [0.25, 1.0, 0.25, 1.0], [4.0, 4.0])], "fr string, en string, scores array<double>, counts array<double>")
    got = {r["fr"]: r for r in phrases.relative_entropy(table).collect()}
    assert got["a b"]["new_logprob"] == pytest.approx(math.log(0.5) + math.log(0.25))
    assert got["a"]["new_logprob"] == pytest.approx(math.log(1e-10))


def test_topics_rerun_alike(spark):
    rows = spark.createDataFrame([(i, ["a", "b"], ["x", "y"], [(0, 0), (1, 1)]) for i in range(6)], "sent long, src array<string>, tgt array<string>, align array<struct<s:int,t:int>>")
    runs = [sorted(map(tuple, topics.fit(rows, 2, 1, 1)[0].collect())) for _ in range(2)]
    assert runs[0] == runs[1] and all(sum(r[4:]) == topics.DRAWS for r in runs[0])
    alpha = topics.distributions(topics.start(topics.pairs_of(rows), 2), 2, 1)[1].agg(F.sum("alpha_0"), F.sum("alpha_1")).first()
    assert alpha[0] == pytest.approx(1) and alpha[1] == pytest.approx(1)


def test_topic_model_runs_the_whole_schedule(spark, monkeypatch):
    from lexshift.plans import catalog

    seen = []
    monkeypatch.setattr(topics, "sweep", lambda state, k, seed: seen.append(k) or state)
    catalog.QUERIES["topic_model"](spark, "/root/testdata/sf0.001")
    assert seen == [4] * 20 + [8] * 20


def test_readers(spark, tmp_path):
    (tmp_path / "D.type.src").write_text("w\ta:1 b:2 a:3\nbad\nv\tc\n")
    rows = {(r["fr"], r["name"]): r["text"] for r in readers.type_features(spark, str(tmp_path / "D.type.src")).collect()}
    assert rows == {("w", "a"): "3", ("w", "b"): "2", ("v", "c"): "1"}
    (tmp_path / "g").write_text("# 1\nx y\nNULL ({ }) a ({ 1 }) b ({ 1 2 })\n")
    rec = readers.giza(spark, str(tmp_path / "g")).first()
    assert rec["src"] == ["a", "b"] and [(p["s"], p["t"]) for p in rec["align"]] == [(0, 0), (1, 0), (1, 1)]
    (tmp_path / "d").write_text("a b\n\tp( a | <s> ) = [2gram] 0.1 [ -1 ]\n\tp( </s> | b ) = [1gram] 0 [ -inf ]\nfile x\n0 zeroprobs\n\nc\n\tp( c | <s> ) = [1gram] 0.1 [ -9 ]\n")
    assert [r["probs"] for r in readers.debug_scores(spark, str(tmp_path / "d")).orderBy("snt_id").collect()] == [[-1.0, -6.0], [-6.0]]
    (tmp_path / "v").write_text("1 | a\nDEV\n-1 | b:2\nTEST\n1 | c\n")
    assert [r["section"] for r in readers.example_sections(spark, str(tmp_path / "v")).orderBy("line_no").collect()] == ["train", "dev", "test"]
    (tmp_path / "p").write_text("a ||| b c ||| 0.1 0.2 0.3 0.4 ||| 0-0 ||| 5 6\n")
    row = readers.phrase_table(spark, str(tmp_path / "p")).first()
    assert row["en"] == "b c" and row["scores"] == [0.1, 0.2, 0.3, 0.4] and row["counts"] == [5.0, 6.0]
    assert readers.seen(spark, str(tmp_path / "p")).count() == 0


def test_lines_are_numbered_where_they_lie(spark, tmp_path):
    """Files of many parts and splits: the same numbers as one reader gives, without a window over a file's lines."""
    from tests.oracle import shuffled_rows

    texts = {"a": [f"a{i}" + "x" * (i % 7) for i in range(500)], "b": [f"b{i}" for i in range(40)]}
    for name, text in texts.items():
        (tmp_path / name).write_text("\n".join(text) + "\n")
    spark.createDataFrame([(i, f"c{i}") for i in range(90)], "k int, line string").repartitionByRange(5, "k").sortWithinPartitions("k").select("line").write.text(str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for name, text in {**texts, "c": [f"c{i}" for i in range(90)]}.items():
            got = readers.lines(spark, str(tmp_path / name))
            assert [r["value"] for r in got.orderBy("line_no").collect()] == text and got.agg(F.max("line_no")).first()[0] == len(text)
        assert shuffled_rows(readers.lines(spark, str(tmp_path / "a"))) < 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_debug_blocks_across_chunks(spark, tmp_path):
    """Blocks are the same wherever chunks of lines end."""
    blocks = [[f"s{i}", *[f"\tp( w | v ) = [1gram] 0.1 [ -{j + 1} ]" for j in range(i % 4)], "1 sentences", *[""] * (1 + i % 3)] for i in range(60)]
    (tmp_path / "d").write_text("\n".join(x for b in blocks for x in b) + "\n")
    for chunk in (1, 2, 7, 10_000):
        got = [tuple(r) for r in readers.debug_scores(spark, str(tmp_path / "d"), chunk).orderBy("snt_id").collect()]
        assert got == [(i + 1, f"s{i}", [float(-min(j + 1, 6)) for j in range(i % 4)]) for i in range(60) if i % 4]


def test_file_names_are_taken_apart_once_for_each_part(spark, tmp_path):
    """Not once for each line: the regular expressions stand above the parts' aggregate, none above the lines."""
    (tmp_path / "new-old.token.x").write_text("a b:2\n\nc\n")
    got = readers.token_features(spark, str(tmp_path / "new-old.token.x"))
    assert [tuple(r) for r in got.orderBy("line_no", "name").collect()] == [("new", "x", 1, "a", "1", 1.0), ("new", "x", 1, "b", "2", 2.0), ("new", "x", 3, "c", "1", 1.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "token)" not in plan[: plan.index("Join")] and "token)" in plan


def test_last_numbers_are_hashed(spark):
    rows = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "x", 3, 0.25), ("a", "x", 2, 0.75), ("b", "x", 1, None)], "f string, e string, line_no long, p double")
    got = labels.last_wins(rows, ["f", "e"])
    assert sorted(map(tuple, got.collect())) == [("a", "x", 3, 0.25), ("b", "x", 1, None)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pair_counts_move_no_line(spark, tmp_path):
    from tests.oracle import shuffled_rows

    (tmp_path / "p").write_text("".join(f"f{i}__e {i} {i + 1}\n" for i in range(2000)))
    got = readers.pair_counts(spark, str(tmp_path / "p"))
    assert shuffled_rows(got) < 50
    assert sorted(map(tuple, got.collect())) == [(i + 1, f"f{i}", "e", i, i + 1) for i in range(300)]


def test_terms_are_moved_once_for_weights(spark):
    """A document that comes in two rows is one document; cells are dealt out by term once and nothing else is as large."""
    from lexshift.operators import retrieval
    from tests.oracle import shuffled_rows

    docs = spark.createDataFrame([(d % 40, [f"w{(d * 7 + i) % 900}" for i in range(300)] + ["twice"] * 2) for d in range(41)], "doc long, tokens array<string>")
    cells = retrieval.term_counts(docs)
    assert cells.filter("doc = 0 AND term = 'twice'").first()["n"] == 4
    assert shuffled_rows(cells) == 41
    assert shuffled_rows(retrieval.weigh_bm25(cells)) < 1.5 * cells.count()


def test_generators_of_many_seeds(monkeypatch):
    """Draws are those of default_rng, also where a generator's memory can't be set; no generator is built for each seed."""
    from lexshift.functions import draws

    seeds = np.concatenate([[0, 1, 2**32 - 1, 2**32, 2**63 - 1], np.random.default_rng(4).integers(0, 2**63 - 1, 300)])
    n, p = np.array([0.01, 3.01, 100.01, 1.0]), [0.1, 0.2, 0.3, 0.4]
    expected = [(g.multinomial(100, p).tolist(), g.standard_gamma(n).tolist()) for g in map(np.random.default_rng, seeds.tolist())]
    for words in (draws._words, lambda bits: None):
        monkeypatch.setattr(draws, "_words", words)
        assert [(g.multinomial(100, p).tolist(), g.standard_gamma(n).tolist()) for g in draws.generators(seeds)] == expected
    monkeypatch.setattr(np.random, "default_rng", None)
    counts = pa.RecordBatch.from_pydict({"f": ["a"] * 3, "n_0": [1, 2, 3], "n_1": [0, 0, 5], "seed": [-1, 5, 2**62]})
    assert next(iter(topics._gammas(2)([counts]))).num_rows == 3


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"], ["x", "y"], [(0, 1)])], "sent long, src array<string>, tgt array<string>, align array<struct<s:int,t:int>>")
    writers.write_lines(writers.bitext_lines(rows)[2], str(tmp_path / "o"), gzip=True)
    assert spark.read.text(str(tmp_path / "o")).first()["value"] == "0-1"


def test_learning(spark):
    rows = spark.createDataFrame([(i, "t%d" % (i % 5), 1 if i % 2 else -1, {"x": float(i % 2), "y": float(i % 3)}) for i in range(60)], "key long, fr string, label int, features map<string,double>")
    space = learn.Space(["x", "y"])
    v = space.vectors(rows)
    best, model = learn.fit_logistic(v, v, learn.logistic_configs(60, 2))
    assert metrics.auroc(learn.scored(model, v).select("score", "label")).first()["auroc"] == 1.0
    assert learn.readable(model, space)[0][0] == "x" and len(power_set(["a", "b"])) == 4
    assert [c["v"] for c in learn.value_range("v", 0, 0.3, 0.1)] == pytest.approx([0, 0.1, 0.2])
    with pytest.raises(ValueError):
        Experiment(train=("a",), test=("a",))


def test_dt_newsense_searches_the_whole_grid(spark, monkeypatch):
    from lexshift.plans import catalog

    seen, search = [], learn.search
    monkeypatch.setattr(learn, "search", lambda train, dev, configs, make: seen.extend(configs) or search(train, dev, configs[:1], make))
    assert catalog.QUERIES["dt_newsense"](spark, "/root/testdata/sf0.001").count() == 1
    assert seen == learn.tree_configs() and len(seen) == 56


def test_copula(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (1, 2, 2, 3)], "dim int, value double")
    assert sorted(r["cdf"] for r in copula.ecdf(rows).collect()) == [0.25, 0.75, 0.75, 1.0]


def test_vine_counts_all_rows_and_columns(spark, monkeypatch):
    """Against all pairs of rows, with ties, a value that most rows share and groups of few rows."""
    monkeypatch.setattr(copula, "GROUP_ROWS", 5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    x[:, 1] = np.where(rng.random(600) < 0.4, 7.0, np.round(x[:, 0] + x[:, 1], 1))
    x[:, 3] -= x[:, 2]
    x[0, 2] = 1e12
    odd = [None, [1.0], [None] * 4, [float("nan")] * 4]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*x.tolist(), *odd])], "k long, v array<double>")
    got = {r["left"]: r["tau"] for r in copula.vine_pairs(frame, "v").collect()}
    signs = [np.sign(c[:, None] - c[None, :]) for c in x.T]
    assert got == pytest.approx({i: (signs[i] * signs[i + 1]).sum() / (600 * 599) for i in range(3)}, abs=1e-12)
    assert copula.vine_pairs(frame.limit(0), "v").count() == 0


def test_running_totals_with_an_outlier(spark):
    rows = spark.createDataFrame([(float(v),) for v in (*range(500), 1e300)], "score double").selectExpr("0 AS k", "score", "1 AS n")
    out = descending_totals(rows, ["k"], "score", ["n"]).collect()
    assert all(r["n_before"] == (0 if r["score"] == 1e300 else 500 - r["score"]) for r in out)
    sizes = pd.Series([r["_bucket"] for r in out]).value_counts()
    assert len(sizes) > 50 and sizes.max() < 20


def test_cap_and_spans(spark):
    tokens = spark.createDataFrame([("a", "d", i) for i in range(5)], "fr string, domain string, line_no long")
    assert sorted(r["line_no"] for r in features.capped(tokens, 2).collect()) == [0, 1]
    spans = spark.createDataFrame([(1, 0, 1, "x y"), (1, 1, 1, "z")], "snt_id long, fr_start int, fr_end int, fr string")
    assert features.span_errors(spans, spark.createDataFrame([(1, ["x", "y"])], "snt_id long, tokens array<string>")).count() == 1


def test_phrases_of_any_length(spark):
    from lexshift.operators import phrases

    long = " ".join(f"w{i}" for i in range(20))
    table = spark.createDataFrame([(long,), (" ".join(f"w{i}" for i in range(3, 18)),), ("w4",)], "fr string")
    got = {(r["start"], r["end"]) for r in phrases.source_matches(table.filter(table.fr == long), table).collect()}
    assert got == {(0, 19), (3, 17), (4, 4)}


def test_features_are_never_dropped(spark):
    from lexshift.operators.learn import Space

    rows = spark.range(30).selectExpr("concat('f', id) AS name")
    assert len(Space.of(rows, most=30).names) == 30
    with pytest.raises(ValueError):
        Space.of(rows, most=29)
