"""Line dedup and the pipeline against plain versions.

The plain line dedup compares all pairs of lines by edit distance over words and
knows nothing of SimHashes.
"""

import os
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from cinderbox.llm import linededup, mixing, quality
from cinderbox.llm.common import kept_apart, materialise, table
from test_small_operators import DOCS, docs_of, edge_rows, jaccard_components

UNSPACED = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words_of(line):
    return tuple(WORDS.findall(UNSPACED.sub(r" \1 ", line.lower())))


def plain_dedup(rows):
    """Texts by (doc_id, text) after dedup; doc ids must be different for different rows."""
    found = {}
    for i, t in rows:
        for pos, x in enumerate((t or "").split("\n")):
            if n := words_of(x):
                found.setdefault(n, []).append((i, pos))
    lines = sorted(found)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [(x, frozenset(x)) for x in lines if len(x) >= linededup.MIN_WORDS]
    for k, (a, own) in enumerate(long):
        for b, other in long[:k]:
            # an edit takes one word out and puts one in at most
            if abs(len(a) - len(b)) <= 1 and len(own ^ other) <= 2 and edits(a, b) <= 1:
                root[find(a)] = find(b)
    keep = {}
    for x in lines:
        keep[find(x)] = min(keep.get(find(x), found[x][0]), min(found[x]))
    gone = {o for x in lines for o in found[x] if o != keep[find(x)]}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def like_lines():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8)))
    bases = [[word() for _ in range(rng.choice([3, 6, 12, 60, 150]))] for _ in range(14)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(w) // 4])):
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice(["", " "]) + " ".join(w).capitalize() + rng.choice(["", "  "]))
        rows.append((i, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, rows[0][1]), (103, "\n\n"), (104, "É à ü ß one two\né À Ü ß ONE two")]


def same_texts(got, rows):
    want = plain_dedup(rows)
    assert {r.doc_id: r.text if r.text is None or r.lines_out else "" for r in got} == want


def test_line_dedup_against_all_pairs(spark):
    rows = like_lines()
    df = docs_of(spark, [(i, t, "s") for i, t in rows]).withColumns({"row": F.lit(1), "pos": F.lit(2), "lines_out": F.lit(3)})
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.drop("lines_out").columns, "lines_in", "lines_out"]
    got = out.collect()
    same_texts(got, rows)
    assert sum(r.lines_in - r.lines_out for r in got) > 20


@pytest.mark.parametrize("few", [8, 1])
def test_every_line_of_one_edit_is_found(spark, monkeypatch, few):
    """Recall against edit distance alone: lines of 5 to 120 words from few words, so that buckets are large."""
    monkeypatch.setattr(linededup, "FEW", few)
    rng = random.Random(21)
    lines = []
    for n in [5] * 60 + [6] * 40 + [9] * 20 + [20] * 10 + [120] * 5:
        base = [f"w{int(rng.expovariate(0.2))}" for _ in range(n)]
        lines.append(base)
        for _ in range(2):
            w, at = list(base), rng.randrange(n)
            w[at:at + rng.choice([0, 1])] = [f"w{int(rng.expovariate(0.2))}"] * rng.choice([0, 1, 1])
            lines.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    same_texts(linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect(), rows)


def similar_components(lines):
    """The least line of each line's component, by edit similarity of 0.8 alone over all pairs."""
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(lines):
        for i, b in enumerate(lines[:k]):
            if 5 * edits(a, b) <= max(len(a), len(b)):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    return [find(x) for x in range(len(lines))]


def test_every_line_of_similarity_is_found(spark):
    """Recall against edit similarity of 0.8 alone: chains of two edits and more, whose middle lines are often missing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    lines = []
    for n in [5, 8, 9, 10, 11, 15, 20, 25, 40, 80] * 5 + [12] * 5:
        base = [word() for _ in range(n)] if rng.random() < 0.7 else [rng.choice("ab") for _ in range(n)]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, len(w) // 5 + 2)):
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1, 1])
            lines.append(w)
    shared = ["passage"] * 3 + ["common", "words"]
    lines += [shared + [word() for _ in range(12)] for _ in range(40)]
    lines = [list(x) for x in dict.fromkeys(tuple(w) for w in lines if len(w) >= linededup.MIN_WORDS)]
    roots = similar_components(lines)
    got = linededup.dedup_lines(docs_of(spark, [(i, " ".join(w), "s") for i, w in enumerate(lines)]), further=True).collect()
    assert {r.doc_id for r in got if r.lines_out} == set(roots) and len(set(roots)) < len(lines) - 50


def test_words_are_written_only_of_lines_that_may_be_similar(spark, monkeypatch):
    """Of 40 lines alone, two that share words but whose lengths tell them apart, and two that are two edits apart."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)]
    rows += [(50, " ".join(f"p{j}" for j in range(40))), (51, " ".join(f"p{j}" for j in range(20)))]
    rows += [(60, " ".join(f"q{j}" for j in range(12))), (61, " ".join(f"q{j}" if j not in (3, 8) else f"r{j}" for j in range(12)))]
    written = []
    monkeypatch.setattr(linededup, "materialise", lambda df, name: written.append((name, materialise(df, name))) or written[-1][1])
    got = linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows]), further=True).collect()
    assert {r.doc_id for r in got if not r.lines_out} == {61}
    assert all(x.count() <= 2 for name, x in written if name == "words")


def test_pairs_are_dealt_out_by_what_edits_undo(spark, monkeypatch):
    """A line of 48 words deals 19 pairs out; a pair of words at places that no few edits bring together is not kept."""
    line = [[f"w{j}" for j in range(n)] for n in (48, 49, 10)]
    got = spark.createDataFrame([(w,) for w in line], "w array<string>").select(F.size(linededup.pair_prefix(F.col("w"))).alias("n")).collect()
    assert [r.n for r in got] == [19, 20, 5]
    shared = ["extraordinarily", "longstanding"]
    rows = [(1, " ".join(shared + [f"a{j}" for j in range(12)])), (2, " ".join([f"b{j}" for j in range(12)] + shared))]
    rows += [(3, " ".join(f"q{j}" for j in range(12))), (4, " ".join(f"q{j}" if j not in (3, 8) else f"r{j}" for j in range(12)))]
    counts, left = {}, []

    def counted(df, name):
        out = materialise(df, name)
        counts[name] = out.count()
        if name in ("sharing", "shared", "members", "alike"):
            left.extend(f.removeprefix("file://") for f in out.inputFiles())
        return out

    monkeypatch.setattr(linededup, "materialise", counted)
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    lines = linededup._sharing(df, "text").select(F.col("id").alias("line")).distinct().count()
    assert lines == 2 and counts["sharing"] > 0
    left.clear()
    got = linededup.dedup_lines(df, further=True).collect()
    assert {r.doc_id for r in got if not r.lines_out} == {4}
    # the largest work tables go as soon as they are read; "members" is also a table of the links of one edit
    assert left and sum(os.path.exists(f) for f in left if "/members-" not in f) == 0


def test_similarity_where_letters_of_words_clash(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LETTERS", 2)
    test_similarity_on_words(spark)


def test_similarity_on_words(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(150):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 26))]
        b = list(a)
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(b))
            b[at:at + rng.choice([0, 1])] = [rng.choice("abcdefghij")] * rng.choice([0, 1, 1])
        pairs.append((a, b or ["x"]))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r.s for r in df.select(linededup.similar(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [5 * edits(a, b) <= max(len(a), len(b)) for a, b in pairs] and 20 < sum(got) < 140


def test_lines_are_told_apart_by_letters_and_digits(spark):
    line = "One, two three: four-five six 7 ünf"
    rows = [(1, line), (2, line + "\r"), (3, "one\ttwo\tthree\tfour\tfive\tsix\t7\tÜnf"), (4, "  One two  three four five (six) 7 ünf!"), (5, "One two three four five six 8 other")]
    got = {r.doc_id: r.lines_out for r in linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


def test_equal_lines_of_any_length_take_part(spark):
    once = ["no no no no no", "ha " * 73, "今天天气很好我们去公园", "ひらがな、カタカナ", "สวัสดีชาวโลก", "one two two two two", "a b b a", "Yes."]
    rows = [(i, "\n".join([*once, "---", ""])) for i in range(2)] + [(2, "今天天气\n今天天气\nyes")]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert [got[i].lines_out for i in range(3)] == [10, 2, 1] and got[1].text == "---\n"
    same_texts(got.values(), rows)


def test_hashes_of_long_and_short_lines_agree(spark):
    df = docs_of(spark, [(i, t, "s") for i, t in like_lines()])
    x = df.select(F.lit(0).alias("copy"), "doc_id", F.lit(1).alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = x.select("copy", "doc_id", "row", "pos", linededup.words_of(F.col("line")).alias("w")).where(F.size("w") >= linededup.MIN_WORDS)
    a, b = ({(r.doc_id, r.pos): (r.k1, r.k2, r.n, r.sim, r.counts) for r in hashed(x).collect()} for hashed in (linededup._hashed, linededup._hashed_long))
    assert a == b and len(a) > 50
    assert all(sum(c >> 12 * g & 4095 for g in range(5)) == n for _, _, n, _, c in a.values())


def test_simhash_blocks_are_majorities_of_their_words(spark):
    words = [f"w{i}" for i in range(40)]
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = linededup._hashed(spark.createDataFrame([(0, 1, 1, 0, words)], "copy long, doc_id long, row long, pos int, w array<string>")).first()
    for g in range(5):
        own = [x for x in h.values() if x % 5 == g]
        assert got.counts >> 12 * g & 4095 == len(own)
        for b in range(12):
            assert got.sim >> 12 * g + b & 1 == (2 * sum(x >> 8 + b & 1 for x in own) > len(own))


def test_one_edit_on_words(spark):
    base = "a b c d e".split()
    near = [["x", *base], [*base, "x"], base[1:], base[:-1], ["a", "b", "x", "d", "e"], ["a", "b", "b", "c", "d", "e"], ["a", "b", "d", "e"]]
    far = [["b", "a", "c", "d", "e"], base[2:], [*base, "x", "y"], ["x", "b", "c", "d", "y"], ["b", "c", "d", "e", "f", "g"], ["x", "b", "c", "d"], []]
    df = spark.createDataFrame([(base, w) for w in near + far], "a array<string>, b array<string>")
    for x, y in (("a", "b"), ("b", "a")):
        got = [r.e for r in df.select(linededup.one_edit(F.col(x), F.col(y)).alias("e")).collect()]
        assert got == [True] * len(near) + [False] * len(far)


def test_large_group_and_long_line(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:190] + [f"x{i}"] + words[191:])) for i in range(300)]
    long = [f"z{i % 70_000}" for i in range(140_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[1:])), (1002, " ".join(long[2:]))]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert [got[i].lines_out for i in (1000, 1001, 1002)] == [1, 0, 0]
    assert sum(r.lines_out for i, r in got.items() if i < 300) == 1 and got[0].lines_out == 1


def test_groups_take_no_pairs(spark):
    """Lines that share most of their words, no two of them one edit apart, and one that links with another."""
    words = [[f"w{j}" for j in range(12)] for _ in range(200)]
    for i, w in enumerate(words):
        w[i % 12], w[(i * 7 + 5) % 12] = f"x{i}", f"y{i}"
    words.append([*words[0][:-1], "other"])
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "sid long, w array<string>")
    assert [(r.a, r.b) for r in linededup._grouped(materialise(df, "words")).collect()] == [(0, 200)]


def test_repeated_rows_link_like_single_ones(spark):
    line = "one two three four five six seven eight"
    rows = [(1, line + "\nother words here")] * 5 + [(2, line.replace("four", "4"))] + [(3, "w " * 1500 + "x")] * 3 + [(4, "w " * 1500 + "y")]
    got = linededup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((r.doc_id, r.lines_out) for r in got) == [*[(1, 2)] * 5, (2, 0), *[(3, 1)] * 3, (4, 0)]


def test_line_dedup_edges(spark):
    df = docs_of(spark, edge_rows())
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(edge_rows())
    texts = {7: "line\n"}
    assert sorted((r.text or "") for r in got) == sorted(texts.get(i, t or "") for i, t, _ in edge_rows())
    assert linededup.dedup_lines(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = docs_of(spark, [(r.doc_id, r.text, r.source) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()])
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(f"file://{folder}/{k}")
        out.append(spark.read.parquet(f"file://{folder}/{k}"))
    return out


def test_stages_hand_on_documents(staged):
    assert [d.columns for d in staged[:-1]] == [[c.split(" ")[0] for c in DOCS.split(", ")]] * 5
    assert staged[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_against_plain_stages(spark, staged):
    docs, ruled, lines, unique, mixed, encoded = staged
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept and 0 < len(kept) < docs.count()
    want = plain_dedup([(r.doc_id, r.text) for r in ruled.collect()])
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    groups = jaccard_components([(i, r.text) for i, r in got.items()])
    assert {r.doc_id for r in unique.collect()} == {c for _, _, c in groups}
    plan = mixing.mix_plan(unique).where("copies > 0").collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in plan})
    assert encoded.count() == mixed.count()


def test_work_tables_of_a_failed_stage_go(spark):
    written = []

    def build():
        written.append(materialise(spark.range(3), "kept").inputFiles())
        raise RuntimeError("stage")

    with pytest.raises(RuntimeError):
        kept_apart(spark, build)
    folder = written[0][0].removeprefix("file://").rsplit("/", 1)[0]
    assert written[0] and not os.path.exists(folder)
    out, paths = kept_apart(spark, lambda: materialise(spark.range(3), "kept"))
    assert out.count() == 3 and len(paths) == 1


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
