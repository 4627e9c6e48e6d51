"""Operators on shapes whose results are known or found by plain Python."""

import itertools
import os
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import cohort, components, ensemble, geometry, grid, match, metrics, rle, sampling
from spanmill.sources import files
from spanmill.streaming import arrivals


def pixels(spark, bits, slide="s"):
    return spark.createDataFrame([(slide, i) for i, b in enumerate(bits) if b] or [], "slide string, pos long")


def text(spark, bits, **kw):
    rows = rle.spans_to_text(rle.encode_spans(pixels(spark, bits), ["slide"], **kw), ["slide"]).collect()
    return rows[0]["rle"] if rows else None


def test_rle_of_a_known_mask(spark):
    assert text(spark, [1, 1, 1, 0, 0, 1, 0, 1, 1]) == "1 3 6 1 8 2"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_runs_do_not_depend_on_chunks(spark, chunk):
    bits = [random.Random(5).random() < 0.6 for _ in range(60)]
    assert text(spark, bits, chunk=chunk) == text(spark, bits)


def test_lossy_form_drops_the_border(spark):
    full = spark.range(63).select(F.lit("s").alias("slide"), F.col("id").alias("pos"), F.lit(63).alias("n"))
    assert rle.spans_to_text(rle.encode_spans(full, ["slide"]), ["slide"]).first()["rle"] == "1 63"
    assert rle.spans_to_text(rle.encode_spans(rle.lossy_positions(full, ["slide"], "n"), ["slide"]), ["slide"]).first()["rle"] == "2 61"


def test_decoding_of_odd_texts(spark):
    masks = spark.createDataFrame([("a", "1 3 6 1 8"), ("b", ""), ("c", None), ("d", "4"), ("e", " 2  2 ")], "id string, rle string")
    spans = rle.text_to_spans(masks, "rle", ["id"], F.lit(6)).collect()
    assert sorted((r["id"], r["lo"], r["hi"]) for r in spans) == [("a", 0, 3), ("a", 5, 6), ("e", 1, 3)]


def test_overlap_equals_dense_and(spark):
    rng = random.Random(3)
    a, b = ([rng.random() < 0.5 for _ in range(700)] for _ in range(2))
    spans = [rle.encode_spans(pixels(spark, m), ["slide"]) for m in (a, b)]
    assert rle.overlap(*spans, ["slide"], cell=16).first()["n"] == sum(x and y for x, y in zip(a, b, strict=True))


def test_empty_masks_by_metric(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0)], "i double, p double, t double")
    i, p, t = F.col("i"), F.col("p"), F.col("t")
    out = row.select(metrics.dice_eps(i, p, t), metrics.dice_or_null(i, p, t), metrics.dice_small(i, p, t, 5), metrics.iou_or_null(i, p, t)).first()
    assert tuple(out) == (1.0, None, 1.0, None)


def test_dice_from_batches_equals_the_whole(spark):
    rng = random.Random(9)
    rows = [(k, int(rng.random() < 0.5), int(rng.random() < 0.5)) for k in range(20) for _ in range(30)]
    px = spark.createDataFrame(rows, "item int, p int, t int")
    s = metrics.overlap_sums(px, ["item"], F.col("p"), F.col("t"))
    got = s.agg(metrics.dice_or_null(F.sum("inter"), F.sum("p"), F.sum("t"))).first()[0]
    assert got == pytest.approx(2 * sum(p * t for _, p, t in rows) / sum(p + t for _, p, t in rows))


def disc(cy, cx, r):
    return [(y, x) for y in range(cy - r, cy + r + 1) for x in range(cx - r, cx + r + 1) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r]


def labelled(spark, points, connectivity=4, strip=1024):
    px = spark.createDataFrame([("s", y, x) for y, x in points], "slide string, y long, x int")
    return components.label_runs(components.column_runs(px), connectivity, strip)


def test_two_discs(spark):
    out = labelled(spark, disc(20, 20, 7) + disc(60, 60, 20), 8)
    stats = components.component_stats(out).collect()
    assert sorted(r["area"] for r in stats) == sorted(len(disc(0, 0, r)) for r in (7, 20))
    assert components.component_stats(out, 150).count() == 1
    assert {(r["cy"], r["cx"]) for r in stats} == {(20.0, 20.0), (60.0, 60.0)}


def test_components_against_flood_fill(spark):
    rng = random.Random(2)
    points = {(y, x) for y in range(25) for x in range(25) if rng.random() < 0.55}
    for connectivity in (4, 8):
        seen, sizes = set(), []
        for start in points:
            if start in seen:
                continue
            stack, size = [start], 0
            seen.add(start)
            while stack:
                y, x = stack.pop()
                size += 1
                for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                    q = (y + dy, x + dx)
                    if (connectivity == 8 or abs(dy) + abs(dx) == 1) and q in points and q not in seen:
                        seen.add(q)
                        stack.append(q)
            sizes.append(size)
        for strip in (1024, 4):  # in one strip, and joined across the borders of several
            got = components.component_stats(labelled(spark, sorted(points), connectivity, strip)).collect()
            assert sorted(r["area"] for r in got) == sorted(sizes)


def test_spiral_is_one(spark):
    points, y, x, dy, dx, turn = [], 0, 0, 0, 1, 0
    for length in range(40, 0, -2):
        for _ in range(2):
            for _ in range(length):
                points.append((y + 50, x + 50))
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
            turn += 1
    for strip in (1024, 8):
        assert components.component_stats(labelled(spark, sorted(set(points)), strip=strip)).count() == 1


def test_rectangle_area_and_centre(spark):
    ring = geometry.rectangle(F.lit(1), F.lit(1), F.lit(5), F.lit(4))
    r = spark.range(1).select(ring.alias("r")).select(geometry.area(F.col("r")).alias("a"), geometry.centre(F.col("r")).alias("c"), geometry.inside(F.lit(2.0), F.lit(2.0), F.col("r")).alias("in"), geometry.inside(F.lit(6.0), F.lit(2.0), F.col("r")).alias("out")).first()
    assert r["a"] == 12 and tuple(r["c"]) == (3.0, 2.5) and r["in"] and not r["out"]


def test_fill_of_a_concave_polygon(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)]
    obj = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in ring])], "id int, ring array<struct<x:double,y:double>>")
    got = {(r["y"], x) for r in geometry.fill(obj, ["id"]).collect() for x in range(r["lo"], r["hi"])}

    def inside(x, y):
        hits = 0
        for (ax, ay), (bx, by) in itertools.pairwise(ring):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hits += 1
        return hits % 2 == 1

    assert got == {(y, x) for y in range(-1, 12) for x in range(-1, 12) if inside(x + 0.5, y + 0.5)}


def _best_total(score):
    """The largest total of a one-to-one matching, by all of them."""
    n, m = score.shape
    wide = np.hstack([score, np.zeros((n, n))])
    return max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m + n), n))


def test_heaviest_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m = (int(k) for k in rng.integers(1, 5, 2))
        score = np.round(rng.random((n, m)), 1) * (rng.random((n, m)) < 0.7)
        i, j = np.nonzero(score)
        if len(i):
            kept = match.heaviest(i, j, score[i, j])
            assert len(set(i[kept])) == len(set(j[kept])) == len(kept)
            assert score[i, j][kept].sum() == pytest.approx(_best_total(score))


def test_optimal_match_has_the_largest_total(spark):
    """Groups of all shapes, ties and chains among them, against all matchings; nulls, zeros and repeated pairs."""
    rng = np.random.default_rng(9)
    rows, want = [("g0", None, 1, 0.5), ("g0", 1, 1, None), ("g0", 2, 2, 0.0), (None, 3, 3, 0.7)], {}
    for g in range(1, 60):
        n, m = (int(k) for k in rng.integers(1, 5, 2))
        score = np.round(rng.random((n, m)), 1) * (rng.random((n, m)) < 0.6)
        if score.any():
            want[f"g{g}"] = _best_total(score)
            rows += [(f"g{g}", i, j, float(score[i, j])) for i, j in zip(*np.nonzero(score), strict=True) for i, j in [(int(i), int(j))]]
    rows += [(*r[:3], r[3] / 2) for r in rows if r[3]]
    got = match.optimal_match(spark.createDataFrame(rows, "slide string, a int, b int, iou double"), "slide", "a", "b", "iou").collect()
    total = {}
    for r in got:
        total[r["slide"]] = total.get(r["slide"], 0) + r["iou"]
    assert total == pytest.approx(want)
    assert len({(r["slide"], r["a"]) for r in got}) == len({(r["slide"], r["b"]) for r in got}) == len(got)


def test_optimal_match_of_a_long_chain(spark):
    """5,000 objects that all hang together, of which a round settles one: a sparse part, no grid of all by all."""
    rows = [("s", k, k + d, (0.5 if d else 0.6) + (k * 7 % 11) / 100) for k in range(5_000) for d in (0, 1)]
    got = match.optimal_match(spark.createDataFrame(rows, "slide string, a int, b int, iou double"), "slide", "a", "b", "iou")
    own = got.agg(F.count(F.lit(1)), F.count_distinct("a"), F.count_distinct("b"), F.sum("iou")).first()
    best = (0.0, -1.0)  # totals up to here if the next b is free, and if it is taken
    for k in range(5_000):
        here, there = rows[2 * k][3], rows[2 * k + 1][3]
        best = (max(best[0], best[0] + here, best[1]), max(best) + there)
    assert own[0] == own[1] == own[2] and own[3] == pytest.approx(max(best))


def test_staple_of_alike_and_missing_votes(spark):
    kind = "item int, expert int, v int"
    of = lambda rows: {r["item"]: r["weight"] for r in ensemble.staple(spark.createDataFrame(rows, kind), ["item"], "expert", "v").collect()}
    assert of([(1, 1, 1), (2, 2, 1), (3, None, 0), (4, 1, None)]) == {1: 1.0, 2: 1.0}
    assert of([(1, 1, 0), (1, 2, 0)]) == {1: 0.0}
    assert of([]) == {}


def test_optimal_and_greedy_match(spark):
    pairs = spark.createDataFrame([("s", 1, 10, 0.9), ("s", 1, 20, 0.8), ("s", 2, 10, 0.85), ("s", 2, 30, 0.1)], "slide string, a int, b int, iou double")
    best = {(r["a"], r["b"]) for r in match.optimal_match(pairs, "slide", "a", "b", "iou").collect()}
    assert best == {(1, 20), (2, 10)}
    greedy = {(r["a"], r["b"]) for r in match.greedy_match(pairs, "slide", "a", "b", "iou", 0.2).collect()}
    assert greedy == {(1, 10)}


def test_scratch_is_cleaned(spark):
    """Nothing stays in the shared folder once the rows of a query have been read."""
    from spanmill.plans import session
    from spanmill.queries import QUERIES
    from tests.compare import DATA

    here = os.path.dirname(session.shared_path(spark, "x").removeprefix("file://"))
    own = lambda: {n for n in os.listdir(here) if n.startswith("spanmill-")} if os.path.isdir(here) else set()
    before = own()
    with session.cleaned(spark):
        for name in ("tiff_window", "object_match_greedy", "contours_all", "cohort_quartiles"):
            assert QUERIES[name](spark, DATA).count() > 0
        assert own() > before
    assert own() == before


def test_connected_parts(spark):
    """A long chain, a star of many, a ring, a node linked to itself, nulls and repeats."""
    from spanmill.operators.graph import connected

    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)]
    rows = chain + [("m500", f"m{k}") for k in range(300)] + [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)] + [("alone", "alone"), (None, "x"), ("y", None)] + chain[:20]
    random.Random(1).shuffle(rows)
    got = {r["node"]: r["part"] for r in connected(spark.createDataFrame(rows, "a string, b string")).collect()}
    want = {f"c{k:03d}": "c000" for k in range(121)} | {"m500": "m0"} | {f"m{k}": "m0" for k in range(300)} | {f"r{k}": "r0" for k in range(7)} | {"alone": "alone"}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def in_order(rows, least):
    taken, out = set(), set()
    for key in sorted({(g, a) for g, a, _, _ in rows}):
        for s, b in sorted((-s, b) for g, a, b, s in rows if (g, a) == key):
            if (key[0], b) not in taken:
                if -s >= least and -s > 0:
                    taken.add((key[0], b))
                    out.add((*key, b, -s))
                break
    return out


def test_greedy_match_is_the_ordered_one(spark):
    rng = random.Random(12)
    rows = {(g, rng.randrange(40), rng.randrange(40)): rng.choice([0.0, 0.1, 0.5, 0.5, 0.7, rng.random()]) for g in "xyz" for _ in range({"x": 30, "y": 200, "z": 700}[g])}
    rows = [(*k, s) for k, s in rows.items()]
    # a chain in which each waits for the one before
    rows += [("chain", k, k, 0.5) for k in range(30)] + [("chain", k, k - 1, 0.9) for k in range(1, 30)]
    odd = [("x", None, 1, 0.9), ("x", 1, None, 0.9), (None, 1, 1, 0.9), ("x", 2, 2, None), ("y", 1, 1, 0.0)]
    df = spark.createDataFrame(rows + rows[:50] + odd, "slide string, a int, b int, iou double")
    got = match.greedy_match(df, "slide", "a", "b", "iou", 0.2)
    assert {tuple(r) for r in got.collect()} == in_order(rows, 0.2) and got.count() == len(in_order(rows, 0.2))
    assert match.greedy_match(df.limit(0), "slide", "a", "b", "iou", 0.2).count() == 0


def test_greedy_match_of_one_large_part(spark):
    """A part of 60,000 pairs that are all connected, in a few rounds and no group in one task."""
    pairs = spark.range(20_000).select(F.lit("s").alias("slide"), F.col("id").cast("int").alias("a"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    pairs = pairs.select("slide", "a", ((F.col("a") + F.col("k")) % 20_000).alias("b"), (0.3 + (F.xxhash64("a", "k") % 1000 + 1000) / 4000).alias("iou"))
    got = match.greedy_match(pairs, "slide", "a", "b", "iou", 0.2)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    rows = {tuple(r) for r in got.collect()}
    assert rows == in_order_fast([tuple(r) for r in pairs.collect()])


def in_order_fast(rows):
    taken, out, own = set(), set(), {}
    for g, a, b, s in rows:
        own.setdefault(a, []).append((-s, b, g))
    for a in sorted(own):
        for s, b, g in sorted(own[a]):
            if b not in taken:
                taken.add(b)
                out.add((g, a, b, -s))
                break
    return out


def test_roi_measures(spark):
    a = labelled(spark, disc(10, 10, 5) + disc(30, 30, 6), 8)
    assert tuple(match.roi_measures(a, a, 0.5).select("recall", "precision", "f1").first()) == (1, 1, 1)
    b = labelled(spark, disc(10, 11, 5), 8)
    inter, union = len(set(disc(10, 10, 5)) & set(disc(10, 11, 5))), len(set(disc(10, 10, 5)) | set(disc(10, 11, 5)))
    assert [r["iou"] for r in match.label_iou(a, b).collect()] == [pytest.approx(inter / union)]
    assert tuple(match.roi_measures(a, b, 0.5).select("tp", "recall", "precision").first()) == (1, 1.0, 0.5)
    assert match.roi_measures(a, labelled(spark, disc(60, 60, 2), 8), 0.5).first()["tp"] == 0


def test_box_pairs_are_all_and_once(spark):
    rng = random.Random(8)
    boxes = [(i, "A" if i % 2 else "B", x, y, x + rng.randint(1, 90), y + rng.randint(1, 90)) for i in range(60) for x, y in [(rng.randint(0, 300), rng.randint(0, 300))]]
    df = spark.createDataFrame([("s", *b) for b in boxes], "slide string, id int, g string, x0 int, y0 int, x1 int, y1 int")
    got = match.box_pairs(df.filter("g = 'A'"), df.filter("g = 'B'"), 37, ["slide"]).select("a_id", "b_id").collect()
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] == "A" and b[1] == "B" and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_staple_follows_the_good_experts(spark):
    rng = random.Random(1)
    truth = [rng.random() < 0.4 for _ in range(300)]
    rows = [(i, e, int(t if rng.random() < q else not t)) for i, t in enumerate(truth) for e, q in ((1, 0.97), (2, 0.95), (3, 0.6))]
    got = ensemble.staple(spark.createDataFrame(rows, "item int, expert int, v int"), ["item"], "expert", "v").collect()
    prior = sum(v for *_, v in rows) / len(rows)
    p, q = dict.fromkeys((1, 2, 3), 0.99), dict.fromkeys((1, 2, 3), 0.99)
    votes = {}
    for i, e, v in rows:
        votes.setdefault(i, {})[e] = v
    for _ in range(50):
        w = {}
        for i, own in votes.items():
            a = prior * math.prod(p[e] if v else 1 - p[e] for e, v in own.items())
            b = (1 - prior) * math.prod(1 - q[e] if v else q[e] for e, v in own.items())
            w[i] = a / (a + b)
        for e in p:
            p[e] = sum(w[i] for i in votes if votes[i][e]) / sum(w.values())
            q[e] = sum(1 - w[i] for i in votes if not votes[i][e]) / sum(1 - x for x in w.values())
    assert max(abs(r["weight"] - w[r["item"]]) for r in got) < 1e-3
    assert sum((r["weight"] > 0.5) == truth[r["item"]] for r in got) > 280


def test_numbered_equals_a_plain_order(spark):
    keys = random.Random(6).sample(range(10_000), 500)
    out = sampling.numbered(spark.createDataFrame([(k,) for k in keys], "k int"), ["k"], "n", 7).collect()
    assert {r["k"]: r["n"] for r in out} == {k: i for i, k in enumerate(sorted(keys))}


def test_contiguous_folds_have_even_sizes(spark):
    sizes = [r["count"] for r in sampling.contiguous_folds(spark.range(13), ["id"], 4).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [4, 3, 3, 3]


def test_cdf_ends_at_one_and_picks(spark):
    px = spark.createDataFrame([("s", i, float(i % 3)) for i in range(10)], "slide string, pos int, p double")
    cdf = grid.sampling_cdf(px, F.col("p"), ["slide"], ["pos"])
    assert cdf.agg(F.max("cdf")).first()[0] == pytest.approx(1.0)
    assert grid.pick(cdf, ["slide"], "pos", F.lit(0.0)).first()["pos"] == 1
    assert grid.pick(cdf, ["slide"], "pos", F.lit(1.5)).first()["pos"] is None


def test_lookup_of_a_missing_key_is_an_error(spark):
    rows, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no v for k 2"):
        cohort.looked_up(rows, dim, "k", "v").collect()


def test_mode_keeps_all_ties(spark):
    rows = spark.createDataFrame([(2,), (2,), (3,), (3,), (4,), (None,)], "v int")
    assert sorted(r["v"] for r in cohort.modes(rows, "v").collect()) == [2, 3]


def test_geojson_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"type":"Feature","id":"x","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,3],[0,0]],[[1,1],[2,1],[1,1]]]},"properties":{"classification":{"name":"Cortex","colorRGB":1}}},'
        '{"type":"Feature","id":"y","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},"properties":{}}]'
    )
    rows = {r["pos"]: r for r in files.read_geojson(spark, str(tmp_path / "a.json")).collect()}
    assert rows[0]["name"] == "Cortex" and len(rows[0]["parts"]) == 1 and len(rows[0]["parts"][0]) == 5
    assert rows[1]["name"] is None and [len(p) for p in rows[1]["parts"]] == [4, 4]


def test_score_lines_and_listing(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0.5,0.6,0.7\n\n1,1,1\n")
    assert [r["dice"] for r in files.read_scores(spark, str(tmp_path / "s.txt")).collect()] == [0.5, 1.0]
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path), "*.txt", ("s.txt",))


def test_zip_scan(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "one")
        z.writestr("__MACOSX/x", "no")
    assert [(r["member"], bytes(r["data"])) for r in files.read_zip(spark, str(tmp_path)).collect()] == [("d/x.txt", b"one")]


def test_log_refuses_other_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, predicted string")
    files.append_log(rows, str(tmp_path / "log"), rows.schema)
    with pytest.raises(ValueError):
        files.append_log(rows.withColumn("x", F.lit(1)), str(tmp_path / "log"), rows.schema)


def test_stream_of_masks(spark, tmp_path):
    spark.createDataFrame([("a", "1 3", "1 3"), ("b", "1 2", "2 2"), ("c", None, "")], "id string, predicted string, expected string").write.parquet(str(tmp_path / "in"))
    arrivals.score_arrivals(arrivals.read_masks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: round(r["dice"], 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 1.0}


def test_early_stopping(spark):
    log = spark.createDataFrame([(1, e, v) for e, v in enumerate([5.0, 4.0, 4.5, 4.6, 4.7, 3.0], 1)], "run int, epoch int, loss double")
    rows = sampling.best_so_far(log, ["run"], "epoch", "loss", 3).orderBy("epoch").collect()
    assert [r["improved"] for r in rows] == [True, True, False, False, False, True]
    assert [r["stopped"] for r in rows] == [False, False, False, False, False, True]


def test_tile_index_has_random_tiles_of_every_slide(spark):
    from spanmill.operators import sampling

    slides = spark.createDataFrame([(1,), (2,)], "slide long")
    objects = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "slide long, obj long")
    rows = sampling.tile_index(slides, objects, "slide", "obj", 2, 5).collect()
    assert sorted((r["slide"], r["obj"] or 0, r["draw"] or 0) for r in rows) == [(1, 0, 1), (1, 0, 2), (1, 10, 0), (1, 11, 0), (2, 0, 1), (2, 0, 2)]
    drawn = [r["u"] for r in rows if r["draw"]]
    assert len(set(drawn)) == 4 and all(0 <= u < 1 for u in drawn) and all(r["u"] is None for r in rows if r["obj"])
    assert sampling.tile_index(slides, objects, "slide", "obj", 0, 5).count() == 2


def test_ema_of_a_long_run_stays_finite(spark):
    from spanmill.operators import ensemble

    rng = random.Random(1)
    for decay, n in ((0.5, 3000), (0.9, 9000), (0.999, 500)):
        values = [rng.uniform(-5, 9) for _ in range(n)]
        log = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run int, epoch long, loss double")
        got = [r["ema"] for r in ensemble.ema(log, ["run"], "epoch", "loss", decay).orderBy("epoch").collect()]
        want, at = [], values[0]
        for i, v in enumerate(values):
            at = v if i == 0 else decay * at + (1 - decay) * v
            want.append(at)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_running_sums_over_ranges(spark):
    from spanmill.operators.scan import running

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]  # one hot key, a null one
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], [F.desc("i")], {"s": F.col("v"), "n": F.lit(1)}, parts=7).collect()
    assert len(got) == 500
    for r in got:
        own = [v for k, i, v in rows if k == r["k"]]
        upto = [v for k, i, v in rows if k == r["k"] and i >= r["i"]]
        assert (r["s"], r["n"], r["all_s"], r["all_n"]) == (sum(upto), len(upto), sum(own), len(own))


def test_overlap_of_any_polygons():
    import numpy as np

    from spanmill.operators.geometry import _overlap

    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], dtype=float)
    rhomb = np.array([(2, -2), (6, 2), (2, 6), (-2, 2), (2, -2)], dtype=float)
    comb = np.array([(0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)], dtype=float)
    assert _overlap(square, rhomb) == pytest.approx(16) and _overlap(square, square) == pytest.approx(16)
    assert _overlap(square, square + 10) == 0 and _overlap(comb, square) == pytest.approx(4 + 2 + 2)
    half = np.array([(0, 0), (4, 4), (0, 4), (0, 0)], dtype=float)
    assert _overlap(square, half) == pytest.approx(8) and _overlap(half, half[::-1]) == pytest.approx(8)
    rng = np.random.default_rng(3)
    for _ in range(20):  # against points
        p, q = (np.vstack([r, r[:1]]) for r in (rng.uniform(0, 10, (5, 2)), rng.uniform(0, 10, (6, 2))))
        x, y = rng.uniform(0, 10, (2, 20_000))

        def inside(r, x=x, y=y):
            a, b = r[:-1], r[1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                at = a[:, 0] + (y[:, None] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            return (((a[:, 1] > y[:, None]) != (b[:, 1] > y[:, None])) & (x[:, None] < at)).sum(axis=1) % 2 == 1

        assert _overlap(p, q) == pytest.approx(100 * (inside(p) & inside(q)).mean(), abs=1.6)


def test_variants_and_results_are_checked(spark):
    from spanmill.operators import cohort, ensemble, sampling, tta

    assert len(tta.variants(tta.D4)) == 8 and tta.variants((tta.VFLIP,)) == [[("vflip", 0)], [("vflip", 1)]]
    one, two = (spark.createDataFrame(rows, "file string, p double") for rows in ([("f", 1.0), ("g", 2.0)], [("f", 3.0)]))
    both = ensemble.results_with_ensemble([one, two], ["file"], "file", "p")
    with pytest.raises(Exception, match="don't match: g"):
        both.collect()
    good = ensemble.results_with_ensemble([one.filter("file = 'f'"), two], ["file"], "file", "p").filter("model = 'ensemble'").collect()
    assert [(r["file"], r["p"]) for r in good] == [("f", 2.0)]
    with pytest.raises(ValueError):
        sampling.combined(F.lit(0.5), [(0.5, sampling.constant(1.0))])
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "n string")
    with pytest.raises(FileNotFoundError):
        cohort.suffix_join(names("a.tif").withColumnRenamed("n", "i"), names("b_m.png"), "i", "n")
    assert cohort.suffix_join(names().withColumnRenamed("n", "i"), names("b_m.png"), "i", "n").collect() == []


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    from spanmill.plans import session

    class Context:
        master = "spark://host:7077"

        class Conf:
            get = staticmethod(lambda k, d=None: d)

        getConf = staticmethod(lambda: Context.Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_path(Session, "x")


def test_greedy_match_of_kinds_is_that_of_objects(spark, monkeypatch):
    """Kinds of several objects, equal scores of kinds whose numbers alternate, kinds without objects; in one pass and in rounds."""
    rng = random.Random(5)
    a_of = [(g, rng.randrange(9), a) for g in "xyz" for a in range(60)]
    b_of = [(g, rng.randrange(9), b) for g in "xyz" for b in range({"x": 60, "y": 25, "z": 90}[g])]
    pairs = [(g, p, q, rng.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for g in "xyz" for p in range(10) for q in range(10) if rng.random() < 0.5]
    every = [(g, a, b, s) for g, p, q, s in pairs for h, k, a in a_of if (h, k) == (g, p) for i, m, b in b_of if (i, m) == (g, q)]
    want = in_order(every, 0.2)
    tables = [spark.createDataFrame(pairs + pairs[:5] + [("x", 1, 1, None)], "slide string, a_kind long, b_kind long, iou double")]
    tables += [spark.createDataFrame(rows + rows[:9] + [(None, 1, 1)], f"slide string, kind long, {c} long") for c, rows in (("a", a_of), ("b", b_of))]
    for whole in (match.WHOLE, 150, 0):
        monkeypatch.setattr(match, "WHOLE", whole)
        got = match.greedy_match_kinds(*tables, "slide", "a", "b", "iou", 0.2)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100


def test_objects_of_one_box_are_not_paired_to_be_matched(spark, monkeypatch, tmp_path):
    """40 times 40 objects of two boxes, and others: rows written are no more than objects and kinds' pairs."""
    import duckdb

    from spanmill.queries import QUERIES, SQL, objects

    keys = [k * 9000 + d for k in range(40) for d in (2, 1813)] + list(range(20, 60))
    spark.createDataFrame([(k, 1) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    written, cut = [], match.cut

    def watched(df, name="cut", held=None):
        out = cut(df, name, held)
        written.append(out.count())
        return out

    monkeypatch.setattr(match, "cut", watched)
    monkeypatch.setattr(objects, "cut", watched, raising=False)
    got = {tuple(r[c] for c in ("a", "b", "dice", "kind")) for r in QUERIES["object_match_greedy"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT a, b, dice, kind FROM ({SQL['object_match_greedy']})").fetchall())
    assert sum(r[3] == "revised" for r in got) >= 40 and max(written) < 2 * len(keys)
