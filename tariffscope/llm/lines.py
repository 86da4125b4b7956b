"""Fuzzy line deduplication, in DataFrame operations only.

Lines are normalised (lower-case runs of letters and digits, one space apart) and hashed to a
63-bit SimHash of their words, weighted by their lengths as edits are. Lines that agree in two of five blocks of its bits, and
whose lengths may be alike, are candidates, few of which remain after counting differing bits. Those left are verified by edit
similarity, 1 less the distance over the longer length, of ``SIMILARITY`` or more. Of every connected group of
lines the first occurrence, by document and line number, stays.

Counting words' bits: a number holds three counters of 21 bits, so 21 sums over a line's words count 63 bits.
Lines of more than 2^21 characters are therefore only sure to be found if they are equal.

Lines are normalised once and stored, and occur as numbers in all joins; texts are fetched for candidates only, and of
all texts only the documents meet their list of removed lines in a shuffle. A line that a third of all documents share is a partial
aggregate where groups are formed, and its occurrences are spread by adaptive execution where they meet their group.
Within a bucket no pairs are formed but those with a leading line (``links.linked_roots``).

Defined results: a null text stays null, an empty one empty; lines without letters or digits
are never removed; rows equal in id and text are one document, and each gets its result; null ids
come before all others; columns other than text stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch, document_key, once, unused
from tariffscope.llm.links import linked_roots

SIMILARITY = 0.95
LANES, LANE_BITS = 3, 21
MASK = sum(1 << LANE_BITS * k for k in range(LANES))
# Blocks of the 63 bits: first bit and width.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 12), (51, 12))
AGREEING = 2
MOST_BITS = 12
# Steps of sizes, each as far as lines that are alike may differ, in one class of sizes.
CLASS_STEPS = 4
# Characters of a piece at least, pieces of a string at most, and characters by which the next piece's place is found.
PIECE, PIECES, ANCHOR = 64, 40, 16
BROADCAST_LINES = 2_000_000


def normalised(line: Column | str) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    # Of ASCII, a plain class says the same, and is found much faster.
    plain = F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")
    return F.trim(F.when(F.octet_length(line) == F.length(line), plain).otherwise(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")))


def lines_of(documents: DataFrame) -> DataFrame:
    """doc, doc_hash, line_no, ``words`` (normalised) and ``line``, a number for equal ones, of every line that has any."""
    lines = documents.where("text is not null").select(
        *document_key(), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")
    )
    lines = once(lines, "words", normalised("line")).where("words != ''")
    return lines.select("doc", "doc_hash", "line_no", F.xxhash64("words").alias("line"), "words")


def simhashes(lines: DataFrame) -> DataFrame:
    """doc, doc_hash, line_no, line, ``sim`` and ``size`` (characters) of each line."""
    words = lines.withColumn("word", F.explode_outer(F.split("words", " ")))
    hashed = words.select(
        "doc", "doc_hash", "line_no", "line", F.xxhash64("word", F.lit(1)).alias("h"), F.length("word").cast("long").alias("w")
    )
    sums = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(MASK)) * F.col("w")).alias(f"s{i}")
        for i in range(LANE_BITS)
    ]
    counted = hashed.groupBy("doc", "doc_hash", "line_no", "line").agg(*sums, F.sum("w").alias("n"), F.count(F.lit(1)).alias("words"))
    # A bit is set where its counter is over half of n. Then, and only then, a counter's highest bit is set after this sum.
    over = F.lit(MASK) * (F.lit((1 << LANE_BITS - 1) - 1) - F.shiftright("n", 1))
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{i}") + F.col("over"), LANE_BITS - 1).bitwiseAND(F.lit(MASK)), i) for i in range(LANE_BITS)]
    counted = counted.withColumn("over", over)
    sim = bits[0]
    for bit in bits[1:]:
        sim = sim.bitwiseOR(bit)
    return counted.select("doc", "doc_hash", "line_no", "line", sim.alias("sim"), F.expr("n + words - 1").alias("size"))


def _block_keys(sim: str) -> Column:
    """A bucket for each choice of agreeing blocks."""
    blocks = [F.shiftrightunsigned(sim, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    return F.array(*(
        F.xxhash64(F.lit(n), *(blocks[b] for b in chosen))
        for n, chosen in enumerate(combinations(range(len(BLOCKS)), AGREEING))
    ))


def _size_classes(size: str) -> Column:
    """The classes of sizes that a line belongs to, one or two: two lines whose sizes may be alike have one in common.

    Sizes that may be alike lie at most one step apart. A class is CLASS_STEPS steps wide, and the last step belongs to the next class too.
    """
    # Steps are a little wider than the similarity asks, for what floating point numbers lack.
    step = F.floor(F.log(size) / (-math.log(SIMILARITY) * 1.01))
    own = F.floor(step / CLASS_STEPS)
    return F.when(step % CLASS_STEPS == CLASS_STEPS - 1, F.array(own, own + 1)).otherwise(F.array(own))


def _trimmed(a: str, b: str) -> Column:
    """Two strings without most of what they begin and end with alike, which no distance depends on."""
    def step(pair: Column, k: Column) -> Column:
        one, other = pair["a"], pair["b"]
        begin = F.substring(one, F.lit(1), k) == F.substring(other, F.lit(1), k)
        return F.when(begin, F.struct(F.substring(one, k + 1, F.length(one)).alias("a"), F.substring(other, k + 1, F.length(other)).alias("b"))).otherwise(pair)

    def back(pair: Column, k: Column) -> Column:
        one, other = pair["a"], pair["b"]
        end = F.substring(one, -k, k) == F.substring(other, -k, k)
        return F.when(end, F.struct(F.substring(one, F.lit(1), F.length(one) - k).alias("a"), F.substring(other, F.lit(1), F.length(other) - k).alias("b"))).otherwise(pair)

    sizes = F.array(*(F.lit(1 << k) for k in range(11, 2, -1)))
    return F.aggregate(sizes, F.aggregate(sizes, F.struct(F.col(a).alias("a"), F.col(b).alias("b")), step), back)


def _distance(a: Column, b: Column, most: Column) -> Column:
    """The distance of two strings, or ``most`` + 1 where it is larger."""
    return F.when(a == b, 0).otherwise(F.pmod(F.call_function("levenshtein", a, b, most), most + 2))


def _by_words(a: str, b: str) -> Column:
    """At least the distance of two strings: the sum over their words, one by one, if they have equally many; null if not."""
    words = [F.split(c, " ") for c in (a, b)]
    each = F.zip_with(*words, lambda x, y: F.when(x == y, 0).otherwise(F.levenshtein(x, y)))
    return F.when(F.size(words[0]) == F.size(words[1]), F.aggregate(each, F.lit(0), lambda x, y: x + y))


def _by_pieces(a: Column, b: Column, most: Column) -> Column:
    """At least the distance of two strings: the sum over pieces of them, cut before ANCHOR characters that both have near
    the same place; ``most`` + 1 at least where it is larger."""
    piece = F.greatest(F.lit(PIECE), F.ceil(F.length(a) / PIECES).cast("int"))

    def step(state: Column, _: Column) -> Column:
        end = state["skip"] + piece
        anchor = F.substring(state["a"], end + 1, F.lit(ANCHOR))
        at = F.call_function("locate", anchor, state["b"], F.greatest(end + 1 - ANCHOR, F.lit(1)))
        at = F.when((F.length(anchor) == ANCHOR) & (at <= end + 1 + ANCHOR), at).otherwise(0)

        def cut(at: Column) -> Column:
            heads = F.struct(F.substring(state["a"], F.lit(1), end).alias("a"), F.substring(state["b"], F.lit(1), at - 1).alias("b"))
            rests = F.substring(state["a"], end + 1, F.length(state["a"])), F.substring(state["b"], at, F.length(state["b"]))
            cost = state["cost"] + F.transform(F.array(heads), lambda head: _distance(head["a"], head["b"], most))[0]
            return F.when(at > 0, _pieces(*rests, F.lit(0), cost)).otherwise(_pieces(state["a"], state["b"], end, state["cost"]))

        return F.when(state["cost"] > most, state).otherwise(F.transform(F.array(at), cut)[0])

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(a) / piece).cast("int")))
    return F.aggregate(
        steps, _pieces(a, b, F.lit(0), F.lit(0)), step,
        lambda state: F.when(state["cost"] > most, state["cost"]).otherwise(state["cost"] + _distance(state["a"], state["b"], most)),
    )


def _pieces(a: Column, b: Column, skip: Column, cost: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), skip.alias("skip"), cost.alias("cost"))


def _alike(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The ``pairs`` whose strings ``a`` and ``b`` are alike. Distances over words or pieces are no smaller than that of the whole strings and found
    much faster: only where both are too large, whole strings are compared."""
    names = [unused(pairs.columns, c) for c in ("_most", "_trimmed")]
    most, pair = (F.col(c) for c in names)
    longest = f"greatest(length({a}), length({b}))"
    pairs = pairs.withColumn(names[0], F.expr(f"cast(floor({1 - SIMILARITY:.6f} * {longest} + 1e-9) as int)"))
    # Null where words tell already.
    pairs = once(pairs, names[1], F.when(F.coalesce(_by_words(a, b) > most, F.lit(True)), _trimmed(a, b)))
    alike = pair.isNull() | (_by_pieces(pair["a"], pair["b"], most) <= most) | (_distance(pair["a"], pair["b"], most) <= most)
    return pairs.where(alike).drop(*names)


def groups_of_lines(parsed: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``line`` and its ``root`` for lines linked to others; ``parsed`` and ``lines`` are as lines_of() and simhashes()
    give them."""
    # In a shorter line, a single edit is too many: only equal lines are alike, and those are one line here.
    editable = lines.where(f"floor({1 - SIMILARITY:.6f} * size + 1e-9) >= 1")
    distinct = scratch.keep(
        editable.groupBy("line").agg(F.min("sim").alias("sim"), F.min("size").alias("size")), "distinct"
    )
    def texts(wanted: DataFrame) -> DataFrame:
        """line and words of the ``wanted`` lines, each once."""
        few = wanted.count() <= BROADCAST_LINES
        return parsed.select("line", "words").join(F.broadcast(wanted) if few else wanted, "line", "left_semi").groupBy("line").agg(
            F.first("words").alias("words")
        )

    calls = iter(range(1_000_000))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs of lines (a, b) that are alike."""
        n = next(calls)
        wanted = pairs.select(F.col("a").alias("line")).union(pairs.select(F.col("b").alias("line"))).distinct()
        words = scratch.keep(texts(scratch.keep(wanted, f"wanted{n}")), f"texts{n}")
        both = pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
        good = scratch.keep(_alike(both, "words_a", "words_b").select("a", "b"), f"good{n}")
        scratch.drop(f"wanted{n}", f"texts{n}")
        return good

    def verified_nodes(pairs: DataFrame) -> DataFrame:
        """The same for pairs (node, leader) of lines with their SimHashes and sizes."""
        good = verified(pairs.select(F.col("node.line").alias("a"), F.col("leader.line").alias("b")))
        return pairs.join(good, (F.col("node.line") == F.col("a")) & (F.col("leader.line") == F.col("b"))).select("node", "leader")

    # Every line is a node of its own, also among others of its SimHash: these may be unlike it, and like other lines.
    node = F.struct("sim", "line", "size").alias("node")
    blocks = distinct.select(F.explode_outer(_block_keys("sim")).alias("block"), _size_classes("size").alias("classes"), node)
    members = blocks.select("block", F.explode_outer("classes").alias("class"), "node").select(F.xxhash64("block", "class").alias("bucket"), "node")
    # Values of the node itself, so that pairs which cannot be alike are passed over where they would be made.
    like = f"abs(node.size - leader.size) <= floor({1 - SIMILARITY:.6f} * greatest(node.size, leader.size) + 1e-9)"
    close = F.expr(f"bit_count(node.sim ^ leader.sim) <= {MOST_BITS} and {like}")
    roots = linked_roots(members, verified_nodes, scratch, close)
    return roots.select(F.col("node.line").alias("line"), F.col("root.line").alias("root"))


def removed_lines(documents: DataFrame) -> DataFrame:
    """doc, doc_hash and ``removed``, the numbers of its lines that repeat another, where there are any."""
    scratch = Scratch(documents.sparkSession, "lines")
    parsed = scratch.keep(lines_of(documents), "parsed")
    lines = scratch.keep(simhashes(parsed), "lines")
    roots = groups_of_lines(parsed, lines, scratch)
    placed = scratch.keep(
        lines.join(roots, "line", "left")
        .select("doc", "doc_hash", "line_no", F.coalesce("root", "line").alias("group")), "places",
    )
    scratch.drop("parsed", "lines")
    place = F.struct("doc", "doc_hash", "line_no")
    firsts = placed.groupBy("group").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = placed.join(firsts, "group").where(place != F.col("first"))
    return rest.groupBy("doc", "doc_hash").agg(F.collect_set("line_no").alias("removed"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated lines taken out of ``text``, and n_lines and n_removed."""
    documents = documents.drop("n_lines", "n_removed")
    columns = documents.columns
    key, key_hash, gone = (unused(columns, c) for c in ("_doc", "_hash", "_removed"))
    removed = removed_lines(documents).toDF(key, key_hash, gone)
    doc, doc_hash = document_key()
    keyed = documents.withColumns({key: doc, key_hash: doc_hash})
    joined = keyed.join(removed.hint("shuffle_hash"), [key, key_hash], "left")
    # Split once a row: inside a lambda, the split would be repeated for each line.
    lines, listed = F.split("text", "\n"), unused(joined.columns, "_lines")
    joined = once(joined, listed, F.when(F.col(gone).isNotNull(), lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(listed) - 1), F.col(gone))
    text = F.when(
        F.col(gone).isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(F.col(listed), i)), "\n")
    ).otherwise(F.col("text"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in columns),
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"),
    )
