import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from tariffscope.llm import lines
from tests.llm.test_links import roots_of


def norm(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def agree(a, b):
    """Whether two SimHashes are equal in as many blocks as candidates need."""
    same = sum((a ^ b) >> at & ((1 << width) - 1) == 0 for at, width in lines.BLOCKS)
    return same >= lines.AGREEING


def brute(documents, sims):
    """Kept texts by comparing all pairs of lines whose SimHashes make them candidates."""
    every = sorted({norm(l) for _, t in documents if t for l in t.split("\n")} - {""})
    near = [
        (a, b) for i, a in enumerate(every) for b in every[:i]
        if agree(sims[a], sims[b]) and abs(len(a) - len(b)) <= 0.05 * max(len(a), len(b)) and distance(a, b) <= (1 - lines.SIMILARITY) * max(len(a), len(b)) + 1e-9
    ]
    roots = roots_of(near)
    seen, out = {}, []
    for doc_id, text in sorted(documents, key=lambda d: (d[0] is not None, d[0])):
        if text is None:
            out.append((doc_id, None, 0))
            continue
        stay, gone = [], 0
        for n, line in enumerate(text.split("\n")):
            group = roots.get(norm(line), norm(line))
            if group and seen.setdefault(group, (doc_id, text, n)) != (doc_id, text, n):
                gone += 1
            else:
                stay.append(line)
        out.append((doc_id, "\n".join(stay), gone))
    return out


def test_equals_comparing_all_pairs(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    base = [" ".join(word() for _ in range(25)) for _ in range(20)]
    documents = []
    for k in range(40):
        rows = [" ".join(word() for _ in range(draw.randint(1, 30))) for _ in range(4)]
        line = draw.choice(base)
        rows.insert(2, line if k % 3 else line.upper() + "!")
        if k % 5 == 0:  # a letter more: 64 - sized hashes hardly move
            rows.append(draw.choice(base) + "s")
        documents.append((k, "\n".join(rows)))
    documents += [(100, None), (101, ""), (102, "\n\n ?!\n"), (103, "the same\nthe same\n\nThe, same"), (0, documents[0][1]), (None, base[0])]
    frame = spark.createDataFrame([(*d, 7) for d in documents], "doc_id long, text string, removed int")
    got = lines.without_repeats(frame)
    assert got.columns == ["doc_id", "text", "removed", "n_lines", "n_removed"]
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    parsed = lines.lines_of(frame)
    sims = {r.words: r.sim for r in lines.simhashes(parsed).join(parsed.select("line", "words"), "line").collect()}
    want = brute(documents, sims)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=order) == sorted(want, key=order)
    assert sum(r[2] for r in want) > 20
    assert {r.n_lines for r in got.where("doc_id = 103").collect()} == {4}
    assert {r.n_lines for r in got.where("doc_id = 100").collect()} == {0}


def test_a_family_of_near_lines_keeps_one(spark):
    line = "an unusually long line that many documents repeat with a small and different change in each of them number"
    documents = [(k, f"{line} {k % 10}{k // 10 % 10}{k // 100}") for k in range(150)]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    kept = [r.doc_id for r in lines.without_repeats(frame).where("text != ''").collect()]
    assert 0 in kept and len(kept) <= 3


def test_no_python_runs(spark):
    frame = spark.createDataFrame([(1, "a\na")], "doc_id long, text string")
    plan = lines.without_repeats(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert lines.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_share_a_simhash_all_meet_others(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(4, 9)))
    documents, likes = [], []
    for k in range(12):
        words = [word() for _ in range(60)]
        orders = [" ".join(draw.sample(words, 60)) for _ in range(3)]  # one SimHash, unlike each other
        likes += [(3 * k + n, line + " a") for n, line in enumerate(orders)]
        documents += [(3 * k + n, line) for n, line in enumerate(orders)]
    frame = spark.createDataFrame(documents + [(1000 + k, line) for k, line in likes], "doc_id long, text string")
    parsed = lines.lines_of(frame)
    sims = {r.doc: r.sim for r in lines.simhashes(parsed).collect()}
    want = {k for k in range(36) if agree(sims[k], sims[1000 + k]) and (sims[k] ^ sims[1000 + k]).bit_count() <= lines.MOST_BITS}
    gone = {r.doc_id - 1000 for r in lines.without_repeats(frame).where("n_removed = 1").collect()}
    assert gone == want and len(want) > 20


def test_lines_of_like_sizes_share_a_class_and_others_do_not(spark):
    sizes = spark.range(20, 1500).select(lines._size_classes("id").alias("classes"), "id").collect()
    classes = {r.id: set(r.classes) for r in sizes}
    for a in classes:
        assert 1 <= len(classes[a]) <= 2
        for b in range(a - a // 20 - 1, a):
            if b in classes and a - b <= int(0.05 * a + 1e-9):
                assert classes[a] & classes[b], (a, b)
    # Before, a line of 20 words and one of 40 could be candidates by chance.
    assert not classes[100] & classes[200]


def test_strings_are_compared_without_their_common_ends(spark):
    """Before, distances were computed over whole lines."""
    draw = random.Random(17)
    pairs = [("", ""), ("a", "a"), ("aaaa" * 9, "aaaa" * 10), ("ü漢" * 30, "ü漢" * 14 + "x" + "ü漢" * 16)]
    for _ in range(150):
        a = [draw.choice("abü ") for _ in range(draw.choice((20, 63, 64, 300)))]
        b = list(a)
        for _ in range(draw.randint(0, 16)):
            b[draw.randrange(len(b))] = draw.choice("abü漢x")
        pairs.append(("".join(a), "".join(b[: draw.choice((len(b), len(b) - 2))])))
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, x string, y string")
    trimmed = {r.k: r.t for r in frame.select("k", lines._trimmed("x", "y").alias("t")).collect()}
    found = {r.k for r in lines._alike(frame, "x", "y").collect()}
    for k, (a, b) in enumerate(pairs):
        assert distance(trimmed[k].a, trimmed[k].b) == distance(a, b)
        assert (k in found) == (distance(a, b) <= int(0.05 * max(len(a), len(b)) + 1e-9))
    long = "word " * 300
    short = spark.createDataFrame([(long + "one" + long, long + "two" + long)], "x string, y string").select(lines._trimmed("x", "y").alias("t")).first().t
    assert len(short.a) < 20


def test_plain_and_other_letters_are_normalised_alike(spark):
    rows = ["  A-b_c 1!", "Über  1½ 漢字, ok", "", "?!", "\tX y"]
    got = spark.createDataFrame([(r,) for r in rows], "line string").select("line", lines.normalised("line").alias("n")).collect()
    assert {r.line: r.n for r in got} == {"  A-b_c 1!": "a b c 1", "Über  1½ 漢字, ok": "über 1½ 漢字 ok", "": "", "?!": "", "\tX y": "x y"}


def test_simhashes_run_in_compiled_code(spark):
    """Before, a method of 14,820 bytes of code turned sums into bits; the JVM leaves methods above 8,000 uncompiled."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            lines.simhashes(lines.lines_of(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000


def test_bits_are_set_where_their_counter_is_over_half(spark):
    draw = random.Random(31)
    texts = ["ab", "ab cd", "ab cd efg", "a" * 300] + [" ".join("x" * draw.randint(1, 9) + str(draw.randrange(50)) for _ in range(n)) for n in (2, 7, 40, 900)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r.word: r.h for r in frame.select(F.explode(F.split("text", " ")).alias("word")).distinct().select("word", F.xxhash64("word", F.lit(1)).alias("h")).collect()}
    for r in lines.simhashes(lines.lines_of(frame)).collect():
        words = texts[r.doc].split(" ")
        n = sum(map(len, words))
        want = sum(1 << bit for bit in range(63) if 2 * sum(len(w) for w in words if hashes[w] >> bit & 1) > n)
        assert (r.sim, r.size) == (want, len(texts[r.doc]))


def test_words_and_pieces_never_tell_less_than_the_distance(spark):
    """Before, every pair was compared whole; now lines with words replaced, taken out or put in are mostly told by their parts."""
    draw = random.Random(23)
    word = lambda: "".join(draw.choice("abcdeü") for _ in range(draw.randint(1, 9)))
    pairs = [("", ""), ("", "abc"), ("ab " * 40, "ab " * 41), ("a" * 200, "a" * 195 + "b")]
    for _ in range(120):
        a = [word() for _ in range(draw.choice((3, 20, 60)))]
        b = list(a)
        for _ in range(draw.randint(0, 5)):
            at = draw.randrange(len(b))
            b[at : at + draw.choice((0, 1, 1, 2))] = [word() for _ in range(draw.choice((0, 1, 1)))]
            b = b or [word()]
        pairs.append((" ".join(a), " ".join(b)))
    most = 12
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, x string, y string")
    told = frame.select("k", lines._by_words("x", "y").alias("words"), lines._by_pieces(F.col("x"), F.col("y"), F.lit(most)).alias("pieces")).collect()
    tight = 0
    for r in told:
        d = distance(*pairs[r.k])
        assert r.words is None or r.words >= d
        assert min(r.pieces, most + 1) >= min(d, most + 1)
        tight += d <= most and r.pieces <= most
    assert tight > 0.8 * sum(distance(*p) <= most for p in pairs)
    found = {r.k for r in lines._alike(frame, "x", "y").collect()}
    assert found == {k for k, (a, b) in enumerate(pairs) if distance(a, b) <= int(0.05 * max(len(a), len(b)) + 1e-9)}


def test_texts_are_split_once_a_row(spark):
    """Before, a text was split anew for each line that stays."""
    out = lines.without_repeats(spark.createDataFrame([(1, "x\nsame line\ny"), (2, "same line\nz")], "doc_id long, text string"))
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()} == {(1, "x\nsame line\ny", 3, 0), (2, "z", 2, 1)}
    assert not re.search(r"lambdafunction\(split\(", out._jdf.queryExecution().optimizedPlan().toString())
