"""Splitting, clusters, encoding, mixing and truncation on small fixtures, against brute force and exact round trips."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest

from sixline.llm import bpe, cluster, cutoff, mix, split
from sixline.llm.tokens import counter


# --- Splitting ---------------------------------------------------------------------------------

PARTS = ["word ", "end. ", "stop。", "，", "\n", "\n\n", "\r\n", "x" * 130, "0.5", "é́", "， ", "؟ ", " ", "🙂"]


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text(seed):
    r = random.Random(seed)
    s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 400)))
    made = split.cuts(s, 100, 20)
    assert made[0][0] == 0 and made[-1][1] == len(s)
    text = ""
    for a, b, _ in made:
        assert b - a <= 100 and a <= len(text) <= b
        text = text[:a] + s[a:b]
    assert text == s
    for (_, b, forced), (c, _, _) in itertools.pairwise(made):
        assert c <= b
        assert forced or s[b - 1] in " .。，\n\r,!?0 " or s[b].isspace() or not s[b - 1].isalnum()


@pytest.mark.parametrize("n,forced", [(800, False), (801, True), (5000, True)])
def test_forced_needs_a_run(n, forced):
    s = "a b. " * 150 + "x" * n + " end."
    assert (split.longest_run(s) > 800) == forced
    assert any(f for _, _, f in split.cuts(s)) >= forced


def test_ranges_are_stitched():
    r = random.Random(1)
    for _ in range(100):
        s = "".join(r.choice(PARTS[:6]) for _ in range(200))
        assert split.longest_run(s, 17) == split.longest_run(s)


def test_oversized_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 800), (4, "a" * 801), (5, "ab " * 400), (5, "ab " * 400)]
    df = spark.createDataFrame(rows, "piece_no int, text string")
    assert sorted(tuple(r) for r in split.oversized(df, ["piece_no"], "text").select("piece_no", "forced").collect()) == [(4, 1), (5, 0), (5, 0)]
    assert split.oversized(df.limit(0), ["piece_no"], "text").count() == 0


def test_file_pieces(spark, tmp_path):
    s = "Der Fluß trägt. 河流守着灯。 And the lantern waits.\n" * 400
    (tmp_path / "big.txt").write_text(s, encoding="utf-8")
    raw = s.encode()
    got = split.file_pieces(spark, [str(tmp_path / "big.txt")], 300, 50, size=4000).orderBy("start", "end").collect()
    assert all(raw[r.start : r.end].decode() == r.piece and len(r.piece) <= 300 for r in got)
    covered = 0
    for r in got:
        assert r.start <= covered
        covered = max(covered, r.end)
    assert covered == len(raw) and not any(r.forced for r in got)


# --- Clusters ----------------------------------------------------------------------------------

AXES = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}
SCHEMA = "pid long, a double, b double, c double, d double, id string, t timestamp"


def _points(seed, groups):
    r = np.random.default_rng(seed)
    rows, pid = [], 1
    for n, spread in groups:
        centre = r.uniform(0.1, 0.9, 4)
        for _ in range(n):
            rows.append((pid, *np.clip(centre + r.uniform(-spread, spread, 4), 0, 1).tolist(), "x", datetime(2025, 1, 1)))
            pid += 1
    return rows


def test_tight_clusters_against_brute_force(spark):
    rows = _points(3, [(40, 0.004), (9, 0.005), (5, 0.006), (4, 0.003), (2, 0.001), (1, 0), (30, 0.006), (6, 0.0)])
    x, ids = np.array([r[1:5] for r in rows]), np.array([r[0] for r in rows])
    want = {(int(ids[at].min()), int(i)) for at in cluster.largest(x, ids, 0.025, 5) for i in ids[at]}
    bad = [(900, None, 0.1, 0.1, 0.1, "n", datetime(2025, 1, 1)), (901, 1.5, 0.1, 0.1, 0.1, "n", datetime(2025, 1, 1)), (1, 0.0, 0.0, 0.0, 0.0, "old", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows + rows[:7] + bad, SCHEMA)
    got = {(r.cluster_id, r.id) for r in cluster.tight(df, "pid", AXES, 0.025, 5, "t", k=6).collect()}
    assert got == want and len({c for c, _ in want}) == 5


def test_tight_clusters_close_to_each_other(spark):
    # Two clusters 0.03 apart, and one whose points are a chain that is no clique.
    t = datetime(2025, 1, 1)
    rows = [(i, 0.5 + 0.001 * (i % 3), 0.5, 0.5, 0.5, "x", t) for i in range(10)]
    rows += [(100 + i, 0.532 + 0.001 * (i % 3), 0.5, 0.5, 0.5, "x", t) for i in range(6)]
    rows += [(200 + i, 0.1 + 0.01 * i, 0.1, 0.1, 0.1, "x", t) for i in range(4)]
    got = {(r.cluster_id, r.id) for r in cluster.tight(spark.createDataFrame(rows, SCHEMA), "pid", AXES, 0.025, 5, "t", k=3).collect()}
    assert got == {(0, i) for i in range(10)} | {(100, 100 + i) for i in range(6)}


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cluster.tight(empty, "pid", AXES, 0.025).count() == 0
    assert cluster.groups(empty, "pid", AXES).count() == 0


def test_groups_report_sizes(spark):
    got = cluster.groups(spark.createDataFrame(_points(5, [(20, 0.004), (12, 0.004)]), SCHEMA), "pid", AXES, "t", k=2).collect()
    assert {r.size for r in got} == {20, 12} and len(got) == 6


def test_diameter_bound_holds():
    r = np.random.default_rng(0)
    ways = cluster.directions(4)
    for _ in range(300):
        x = r.normal(size=(r.integers(2, 12), 4)) * r.uniform(0.1, 1, 4)
        along = x @ ways.T
        true = np.sqrt(cluster._squared(x, x)).max()
        assert true <= cluster._widest(along.min(0), along.max(0), 4) * (1 + 1e-9)


# --- Encoding ----------------------------------------------------------------------------------


def test_ids_against_the_library(spark):
    import tiktoken

    made = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    r = random.Random(2)
    alphabet = ["a", "the ", "'ll", " ", "\n\n", "　", "\x1c", "é", "漢字", "🙂", "<|endoftext|>", "1234", "!!", "  ", "Z" * 50, "ab" * 300]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(200)] + ["", None, " ", "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "ids long, text string")
    got = {r[0]: list(r[1]) for r in bpe.encode(df.withColumnRenamed("ids", "doc_id"), "doc_id", "text").collect()}
    assert got == {i: made.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_rank_queue_gives_lowest_first():
    r = random.Random(4)
    queue, held = bpe.RankQueue(), []
    for i in range(2000):
        rank = r.randrange(50_000)
        queue.push(rank, i)
        held.append((rank, i))
    out = []
    while (taken := queue.pop()) is not None:
        out += [(taken[0], p) for p in taken[1]]
    assert out == sorted(held)


# --- Mixing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_fit_is_within_counts_and_near(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 200), r.randint(1, 25)))
    counts = [r.randint(1, 30) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    budget = r.randint(0, total + 20)
    took = mix.fit(lengths, counts, budget)
    assert all(0 <= a <= b for a, b in zip(took, counts))
    assert abs(sum(a * b for a, b in zip(lengths, took)) - min(budget, total)) <= max(lengths)


def test_mix_reaches_targets(spark):
    docs = [(i, f"word number {i} " * (1 + i % 7), ["a", "b", "c"][min(2, i % 10 // 4)], "en") for i in range(300)] + [(900, None, "a", "en"), (901, "", "b", "en"), (902, "x", None, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([("m", "byte_bpe_50k", "a", 2.0, 1), ("m", "byte_bpe_50k", "c", 2.0, 3), ("m", "byte_bpe_50k", "none", 1.0, 1), ("n", "piece_bpe_32k", "b", 1.0, None)], "mix_id string, tokenizer string, source string, target_weight double, max_repeats int")
    mixed = mix.mix(df, targets).cache()
    count = counter("byte_bpe_50k")
    sizes = {d: count([t])[0] for d, t, s, _ in docs if t}
    rows = mixed.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {900, 901, 902}
    m = [r for r in rows if r.mix_id == "m"]
    tokens = {s: sum(sizes[r.doc_id] * r.times for r in m if r.source == s) for s in "ac"}
    assert abs(tokens["a"] - tokens["c"]) <= 20 and max(r.times for r in m if r.source == "a") <= 1 and max(r.times for r in m if r.source == "c") <= 3
    shares = {(r.mix_id, r.source): r.share for r in mix.shares(mixed, targets).collect()}
    assert shares["m", "none"] == 0 and abs(shares["m", "a"] - 0.5) < 0.01 and shares["n", "b"] == 1


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "byte_bpe_50k", "a", 1.0, 1)], "mix_id string, tokenizer string, source string, target_weight double, max_repeats int")
    assert mix.mix(df, targets).count() == 0


# --- Truncation --------------------------------------------------------------------------------


@pytest.mark.parametrize("text,how", [
    ("", "blank"), (" \n", "blank"), ("It ends.", "end"), ("It ends.\" ", "end"), ("第一。第二", "prose"), ("One. Two thr", "prose"), ("mean 0.", "number"),
    ("It goes on and...", "dots"), ("Title words", "title"), ("One.\nlast li", "line"),
])
def test_endings(text, how):
    assert cutoff.ending(text)[0] == how


def test_limits_are_found(spark):
    r = np.random.default_rng(1)
    n = np.minimum(np.exp(r.normal(5.5, 0.5, 4000)).astype(int), 400)
    counts = {int(k): int(v) for k, v in zip(*np.unique(n, return_counts=True))}
    df = spark.createDataFrame([("s", "points", k, v) for k, v in counts.items()], "source string, unit string, length long, n long")
    found = cutoff.limits(df).collect()
    assert [r.limit for r in found] == [400] and found[0].posterior > 0.9


def test_truncated(spark):
    lines = ["the mirror guards the gate", "the lantern holds the river", "the window names the stone", "the table opens the ridge", "the river keeps the tower"]
    docs = [(i, "\n".join(lines[i % 5 :] + lines[: i % 5]), "verse") for i in range(40)]
    docs += [(100 + i, f"The keeper waits {i} days. The tower stands. Nobody asks why.", "prose") for i in range(20)]
    docs += [(200, "The keeper waits. The tow", "prose"), (201, None, "prose"), (202, "", None), (203, lines[0] + "\nthe mirror guards the ga", "verse"), (204, "The keeper waits. Nobody as...", "prose"), (204, "It is done.", "prose")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(r.doc_id for r in cutoff.truncated(df).collect())
    assert got == [200, 203, 204]
    rates = {r.source: (r.texts, r.cut) for r in cutoff.rates(df).collect()}
    assert rates["prose"] == (24, 2) and rates["verse"] == (41, 1) and rates[""] == (1, 0)
    assert cutoff.truncated(df.limit(0)).count() == 0


def test_found_queries_on_small_tables(spark):
    from sixline.llm import queries

    d = "/root/testdata/sf0.001"
    for name, columns in (("p3_found", ["scene_id", "forced"]), ("p4_found", ["cluster_id", "profile_id"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id"])):
        df = queries.QUERIES[name](spark, d)
        assert df.columns == columns and df.count() > 0


def _fitted(spark, at_limit):
    """Odds of an undecided ending (``line``) at no limit and at one, where ``at_limit`` is the posterior of its lengths."""
    rows = [("s", "real", "", 0.0, "end", 900), ("s", "real", "", 0.0, "line", 60), ("s", "real", "", 0.0, "prose", 10), ("s", "real", "points 400", at_limit, "line", 1)]
    rows += [("s", "cut", "", 0.0, "line", 300), ("s", "cut", "", 0.0, "prose", 600), ("s", "cut", "", 0.0, "end", 100), ("s", "whole", "", 0.0, "end", 900), ("s", "whole", "", 0.0, "line", 100)]
    table = spark.createDataFrame(rows, "source string, variant string, at string, prior double, class string, n long")
    share = lambda **k: {c: k.get(c, 0.001) for c in cutoff.CLASSES}
    found = cutoff.posteriors(table, share(line=0.3, prose=0.6, end=0.1), share(end=0.9, line=0.1)).collect()
    return {(r["at"], r["class"]): r.odds for r in found}


def test_only_the_length_posterior_decides(spark):
    sure, weak = _fitted(spark, 0.98), _fitted(spark, 0.02)
    assert sure["", "line"] < 0 < sure["points 400", "line"]
    assert weak["points 400", "line"] < 0
    assert sure["", "prose"] > 0 and sure["points 400", "end"] < sure["points 400", "line"]


def test_long_last_lines_are_judged_by_their_end():
    line = "a" * 50 + " " + "word " * 2000 + "unfini"
    how, part = cutoff.ending("One.\n" + line)
    first, n, _, before, last = cutoff._keys(part)
    assert (how, n, before, last) == ("line", 2002, "word", "unfini")
    assert cutoff._keys("x" * 500)[4] != cutoff._keys("x" * 501)[4]


def test_labels_end_texts_inside():
    s = "One line here.\nAnother line there.\n\nThe last line of the text"
    made = dict(cutoff._labels(s, 12345))
    assert s.startswith(made["cut"]) and len(made["cut"]) >= len(s) // 2
    assert made["whole"] in ("One line here.", "One line here.\nAnother line there.")
    assert list(cutoff._labels("short", 3)) == []


def test_neighbours_of_lengths_by_prefix_sums(spark):
    r = np.random.default_rng(2)
    n = np.exp(r.normal(6, 0.6, 20_000)).astype(int)
    counts = {int(k): int(v) for k, v in zip(*np.unique(n, return_counts=True))}
    counts[512] = counts.get(512, 0) + 400
    df = spark.createDataFrame([("s", "points", k, v) for k, v in counts.items()], "source string, unit string, length long, n long")
    assert [r.limit for r in cutoff.limits(df).collect()] == [512]


def test_sizes_by_parts_against_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(3)
    parts = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "漢", "🙂", "0.5", "\x1c", "　", "​", "<s>", "<|endoftext|>", "\x00", "word's"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert counter("piece_bpe_32k")(texts) == [len(v) for v in model.encode(texts)]
    for name in ("word_bpe_49k", "byte_bpe_50k"):
        own = Tokenizer.from_file(f"/opt/tokenizers/{name}.json")
        own.encode_special_tokens = True
        assert counter(name)(texts) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_byte_level_json_is_counted_whole(tmp_path):
    import shutil

    shutil.copy("/opt/tokenizers/byte_bpe_50k.json", tmp_path / "own.json")
    texts = ["two words", " a  b", "", "\n\n x"]
    assert counter("own", str(tmp_path))(texts) == counter("byte_bpe_50k")(texts)


def _mixed(seed, n):
    r = random.Random(seed)
    parts = ["word ", "end. ", "stop。", "，", "\n", "\n\n", "\r\n", "x" * 130, "0.5", "é́", "， ", " ", "🙂", "Fluß "]
    return "".join(r.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_sections_cover_the_text_with_overlaps_at_seams(seed):
    s = _mixed(seed, 4000) + "y" * 9000 * (seed % 2) + _mixed(seed + 50, 500)
    made = split.cuts(s, 100, 20, section=800)
    assert made[0][0] == 0 and made[-1][1] == len(s)
    for (_, b, forced), (c, d, _) in itertools.pairwise(made):
        assert c <= b < d and d - c <= 100
        assert c < b or s[b - 1].isspace() or forced or not s[b - 1].isalnum() or s[b : b + 130] == "x" * 130
        assert forced == (not (s[b - 1].isspace() or s[b].isspace() or s[b - 1] in ".,!?。，")) or not forced
    if seed % 2:
        assert sum(f for *_, f in made) >= 9000 // 100 - 2


def test_long_texts_are_dealt_out(spark):
    texts = [(1, _mixed(1, 9000)), (2, "z" * 20_000), (2, "z" * 20_000), (3, "short. " * 30), (4, None), (5, _mixed(2, 20) + "q" * 801 + " " + _mixed(3, 3000))]
    df = spark.createDataFrame(texts, "piece long, t string")
    got = split.pieces(df, ["piece"], "t", 100, 20, section=800).toDF("k", *[f.split(" ")[0] for f in split._PIECE.split(", ")])
    rows = sorted((r.k, r.piece_no, r.start, r.end, r.forced, r.piece) for r in got.collect())
    want = sorted((k, i, a, b, int(f), t[a:b]) for k, t in texts if t and len(t) > 100 for i, (a, b, f) in enumerate(split.cuts(t, 100, 20, 800), 1))
    assert rows == want
    found = split.oversized(df, ["piece"], "t", 800, 20, section=800).collect()
    assert sorted((r[0], r.forced) for r in found) == sorted((k, int(split.longest_run(t) > 800)) for k, t in texts if t and len(t) > 800)
    assert sorted(r.pieces for r in found) == sorted(len(split.cuts(t, 800, 20, 800)) for k, t in texts if t and len(t) > 800)


def test_file_pieces_are_the_same_for_all_range_sizes(spark, tmp_path):
    raw = (_mixed(7, 60_000) + "n" * 300_000 + _mixed(8, 20_000)).encode() + b"\xff\xfe broken \xe2\x82 end." + _mixed(9, 3000).encode()
    (tmp_path / "big.txt").write_bytes(raw)
    (tmp_path / "empty.txt").write_bytes(b"")
    paths = [str(tmp_path / "big.txt"), f"file://{tmp_path}/empty.txt"]
    made = [sorted(tuple(r) for r in split.file_pieces(spark, paths, 300, 50, size=size).collect()) for size in (1, 600_000, 64 << 20)]
    assert made[0] == made[1] == made[2]
    rows = [r[1:] for r in made[0]]
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and rows[0][1] == 0 and rows[-1][2] == len(raw)
    covered = 0
    for _, start, end, _, piece in rows:
        assert start <= covered < end and raw[start:end].decode("utf-8", "replace") == piece and len(piece) <= 300
        covered = end
    inside = [r for r in rows if set(r[4]) == {"n"}]
    assert len(inside) >= 300_000 // 300 - 10 and all(r[3] for r in inside[:-1])


def _reference_cliques(x, ids, radius, least):
    """The greatest set by trying all, then the greatest of the rest."""
    import itertools as it

    left, out = list(range(len(x))), []
    while True:
        found = None
        for n in range(len(left), least - 1, -1):
            fits = [c for c in it.combinations(left, n) if np.sqrt(cluster._squared(x[list(c)], x[list(c)])).max() <= radius]
            if fits:
                found = min(fits, key=lambda c: sorted(ids[list(c)]))
                break
        if found is None:
            return out
        out.append(len(found))
        left = [i for i in left if i not in found]


@pytest.mark.parametrize("seed", range(8))
def test_overlapping_sets_against_all_subsets(seed):
    r = np.random.default_rng(seed)
    x, ids = r.uniform(0, 0.05, (11, 4)) * [1, 1, 0.3, 0.3], r.permutation(11)
    got = [len(s) for s in cluster.largest(x, ids, 0.03, 3)]
    want = _reference_cliques(x, ids, 0.03, 3)
    assert got == want


def test_a_large_group_with_strays_holds_no_matrix():
    import tracemalloc

    r = np.random.default_rng(1)
    x = np.concatenate([0.5 + r.uniform(0, 0.006, (12_000, 4)), [[0.5 + 0.024, 0.5, 0.5, 0.5], [0.5 - 0.018, 0.5, 0.5, 0.5]], r.uniform(0.6, 0.9, (500, 4))])
    tracemalloc.start()
    made = cluster.largest(x, np.arange(len(x)), 0.025, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 1 and len(made[0]) >= 12_000 and peak < 12_000**2 * 4


def test_clusters_are_described(spark):
    rows = _points(5, [(20, 0.004), (12, 0.004), (3, 0.001)])
    df = spark.createDataFrame(rows, SCHEMA)
    got = cluster.described(cluster.tight(df, "pid", AXES, 0.025, 5, "t", k=3), df, "pid", list(AXES), "t").collect()
    assert {(r.cluster_id, r.size) for r in got} == {(1, 20), (21, 12)} and len(got) == 6
    x = np.array([r[1:5] for r in rows[:20]])
    near = np.sqrt(((x - x.mean(0)) ** 2).sum(1)).argsort()[:3] + 1
    assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.cluster_id == 1] == near.tolist()


def test_overlapping_chains_over_cells_are_disjoint(spark):
    import numpy as np

    from sixline.llm.cluster import largest, tight

    rng, weights = np.random.default_rng(3), {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}
    # Chains longer than any halo, and a tight group with a stray neighbour.
    x = np.concatenate([np.column_stack([rng.uniform(0.1, 0.35, 70), np.full(70, y), np.full(70, 0.5), np.full(70, 0.5)]) for y in (0.2, 0.215)] + [np.full((30, 4), 0.05) + rng.uniform(0, 0.005, (30, 4)), [[0.072, 0.05, 0.05, 0.05]]])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)], "id long, a double, b double, c double, d double")
    got = [(r.cluster_id, r.id) for r in tight(df, "id", weights, 0.02, k=6).collect()]
    want = [(int(ids[at].min()), int(i)) for at in largest(x, ids, 0.02, 5) for i in ids[at]]
    assert len({i for _, i in got}) == len(got)
    assert sorted(got) == sorted(want)


def test_run_with_an_ellipsis_character_is_forced(spark):
    from sixline.llm.split import oversized

    texts = ["a" * 500 + "…" + "b" * 500, "word. " * 200]
    rows = oversized(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ["id"], "text").collect()
    assert {r.id: r.forced for r in rows} == {0: 1, 1: 0}
