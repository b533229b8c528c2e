"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words. A line goes when an earlier line (by document id, then place; rows of
one id by a hash of the text) has a Jaccard similarity of ``4 / 5`` or more with it. Steps:

1. How often words occur, counted over all texts in a table of fixed size, gives one global order of rarity
   (ties by hash). Any such order keeps the join exact; a slot shared by words only blurs rarity.
2. Each line gives a 128-bit key of its token set, and the part of its rarest tokens that any match must
   share one of (prefix filter). Tokens that occur once in all texts cannot be shared and are left out.
3. Equal sets are one entry, at its first line; of those that a task reads together only the first is sent. Entries with a prefix token in common meet if their sizes
   (length filter), the number and the places of the tokens shared (positional filter) and 128-bit signatures
   of the whole sets still allow the threshold. Entries of a token meet in arrays, sorted by token, and by length where
   they are many; the token sets of those left are read again from the texts, and Jaccard is computed exactly.
4. Where most pairs of a token are left, or its entries are too many for an array, their token sets are read again at once. All meet the
   token's earliest entry first, which settles groups of near copies; entries that are not settled then meet the earlier
   ones set by set, in cells of bounded size, and a row comes out for each that has a match, never a row for a pair.
   Both ways are exact.

Tokens are compared by 50-bit hashes. Defined results: null, empty and blank lines have no tokens and stay;
repeated rows (same id and text) are one document and get the same result; null ids come first; an empty
table gives an empty result; columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize, unused
from stacklens.llm.words import chunks, count_of, hashed_bits, hashed_counts, in_bits, mix, words
from stacklens.session import shuffles_removed

#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
#: Numbers of 64 bits in a signature; sets of up to SHORT tokens have them folded into the first.
SIGS, SHORT = ("sig", "sig2"), 64
RARITY_SLOTS, RARITY_ROWS, MET_SLOTS = 1 << 22, 2, 1 << 26
BITS = 50
LINES_AT_ONCE = 1 << (64 - BITS)


def _lines(column: pa.Array):
    """For parts of a text column: row, line number and tokens' range of each line with tokens, and the tokens,
    sorted within their line."""
    for row0, _, data, starts in chunks(column):
        at, h = words(data, starts)
        if not len(at):
            continue
        breaks = np.cumsum(data == 10)
        text = np.searchsorted(starts, at, side="right") - 1
        before = np.concatenate([[0], breaks])[starts[:-1]]
        number = breaks[at] - before[text]
        line = np.cumsum(np.concatenate([[0], (np.diff(text) != 0) | (np.diff(number) != 0)]))
        first = np.flatnonzero(np.concatenate([[True], np.diff(line) != 0]))
        for l0 in range(0, len(first), LINES_AT_ONCE):
            own = first[l0:l0 + LINES_AT_ONCE]
            a, b = own[0], first[l0 + LINES_AT_ONCE] if l0 + LINES_AT_ONCE < len(first) else len(at)
            key = np.sort(((line[a:b] - l0).astype(np.uint64) << np.uint64(BITS)) | (h[a:b] >> np.uint64(64 - BITS)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            local = (key >> np.uint64(BITS)).astype(np.int64)
            tokens = key & np.uint64((1 << BITS) - 1)
            n = np.bincount(local, minlength=len(own))
            yield row0 + text[own], number[own], n, local, tokens


def _keys(n: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    return [np.add.reduceat(mix(tokens, s), at).astype(np.int64) for s in (1, 2)]


def _signatures(tokens: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Signatures of sets of n tokens each: a bit tells whether an odd number of tokens falls there."""
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    slot = mix(tokens, 3) % np.uint64(128)
    bit = np.uint64(1) << (slot & np.uint64(63))
    low, high = (np.bitwise_xor.reduceat(np.where(slot >> np.uint64(6) == k, bit, np.uint64(0)), start) for k in (0, 1))
    short = n <= SHORT
    return [np.where(short, low ^ high, low).view(np.int64), np.where(short, np.uint64(0), high).view(np.int64)]


def _repeats(doc: np.ndarray, tie: np.ndarray, line: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have the key of one at an earlier place, and which are the first one itself once more."""
    order = np.lexsort((line, tie, doc, lo, hi))
    new = np.concatenate([[True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
    of = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first line of its key
    here = (doc[order] == doc[of]) & (tie[order] == tie[of]) & (line[order] == line[of])
    again, double = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order], double[order] = ~here, here & ~new
    return again, double


def _entries(docs: DataFrame, rarity) -> DataFrame:
    """A row per line with tokens: doc, tie, line, key (hi, lo), n, the signature of its tokens, and its prefix tokens
    but for those that occur once; these stand first, so the others have the last places of the prefix. Lines that repeat
    an earlier one read with them (``again``) have no tokens and a key of their own, and rows that stand twice are one."""

    def run(batches):
        for b in batches:
            for row, number, n, local, tokens in _lines(b.column(2)):
                hi, lo = _keys(n, tokens)
                doc, tie = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
                again, double = _repeats(doc, tie, number, hi, lo)
                hi = np.where(again, _place_hash(doc, tie, number).view(np.int64), hi)
                count = count_of(rarity.value, tokens).astype(np.uint64)
                # line, then rarity, then the token, which the place in the sorted tokens stands for
                order = np.sort((local.astype(np.uint64) << np.uint64(50)) | (count << np.uint64(34)) | np.arange(len(tokens), dtype=np.uint64))
                where = (order & np.uint64((1 << 34) - 1)).astype(np.int64)
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                place = np.arange(len(tokens)) - start[local]
                prefix = n - -(-n * NUM // DEN) + 1
                # sets of three tokens or fewer match equal sets only
                used = (place < prefix[local]) & (count[where] > 1) & (n[local] > 3) & ~again[local]
                ends = np.concatenate([[0], np.cumsum(np.bincount(local[used], minlength=len(n)))]).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(tie), pa.array(number, pa.int32()), pa.array(hi), pa.array(lo), pa.array(again),
                     pa.array(n, pa.int32()), *(pa.array(np.where(again, 0, s)) for s in _signatures(tokens, n)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[where][used].astype(np.int64)))],
                    ["doc", "tie", "line", "hi", "lo", "again", "n", *SIGS, "tokens"])
                yield out.filter(pa.array(~double)) if double.any() else out

    return docs.select("doc", "tie", "text").mapInArrow(
        run, "doc long, tie int, line int, hi long, lo long, again boolean, n int, sig long, sig2 long, tokens array<long>")


def _place_hash(doc: np.ndarray, tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.uint64), 1) ^ tie.astype(np.uint64), 2) ^ line.astype(np.uint64)


def _text_hash(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.uint64), 4) ^ tie.astype(np.uint64), 5)


def _sets(docs: DataFrame, met) -> DataFrame:
    """(doc, tie, line, tokens) of lines whose place may be among those that met; other texts are not split."""

    def run(batches):
        for b in batches:
            own = in_bits(met.value, _text_hash(b.column(0).to_numpy(), b.column(1).to_numpy()))
            b = b.filter(pa.array(own))
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, number, n, local, tokens in _lines(b.column(2)):
                keep = in_bits(met.value, _place_hash(doc[row], tie[row], number))
                if keep.any():
                    used = tokens[keep[local]]
                    ends = np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[row][keep]), pa.array(tie[row][keep]), pa.array(number[keep], pa.int32()),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(used.astype(np.int64)))], ["doc", "tie", "line", "tokens"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "doc long, tie int, line int, tokens array<long>")


def _prefix(n: Column) -> Column:
    """How many of n tokens a match must share one of: n - ceil(n * NUM / DEN) + 1."""
    return F.floor((n * (DEN - NUM)) / DEN).cast("int") + 1


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs of places (x, y) that may reach the threshold, from a row (doc, at, size, and y's) per shared prefix token.

    What is shared up to the last shared prefix token is counted. Later tokens in common lie beyond the prefix
    of one of the two, so there are at most as many as either has left, or one has beyond its prefix.
    """
    pairs = rows.groupBy("doc", "at", "y_doc", "y_at").agg(F.count("*").alias("c"), F.max("size").alias("size"), F.max("y_size").alias("y_size"))
    n, m = _upper("size"), _upper("y_size")
    rest = F.least(n - _lower("size") - 1, m - _lower("y_size") - 1, F.greatest(n - _prefix(n), m - _prefix(m)))
    of = lambda doc, at: F.struct(F.col(doc).alias("doc"), _upper(at).alias("tie"), _lower(at).alias("line"))
    return (pairs.where((F.col("c") + rest) * (NUM + DEN) >= (n + m) * NUM)
            .select(of("doc", "at").alias("x"), of("y_doc", "y_at").alias("y")))


def _two(upper: str, lower: str) -> Column:
    """Two ints in one long, ordered as the pair; the lower one is not negative."""
    return F.shiftleft(F.col(upper).cast("long"), 32) + F.col(lower)


def _upper(c: str) -> Column:
    return F.shiftright(c, 32).cast("int")


def _lower(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(2 ** 32 - 1)).cast("int")


def _may(n, m, at, to):
    """Length filter, and the positional filter of one shared token: as many tokens can be shared before it as
    either has there, and after it likewise. No shared token of a matching pair fails."""
    most = np.minimum(at, to) + 1 + np.minimum(n - at - 1, m - to - 1)
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (most * (NUM + DEN) >= (n + m) * NUM)


def _near(n, m, sigs, i, j):
    """Which signatures i and j of sets of n and m tokens differ in no more bits than a matching pair has tokens in one set only."""
    differ = [s[i] ^ s[j] for s in np.atleast_2d(sigs)]
    if len(differ) > 1:
        one = np.minimum(n, m) <= SHORT  # of a longer one the halves are folded as well
        differ = [np.where(one, differ[0] ^ differ[1], differ[0]), np.where(one, 0, differ[1])]
    apart = sum(np.bitwise_count(d.view(np.uint64)).astype(np.int64) for d in differ)
    return apart * (NUM + DEN) <= (n + m) * (DEN - NUM)


#: Entries of a token meet each other in arrays, those of tokens with up to FEW at once, if that leaves at most DENSE pairs
#: for each. Those of other tokens meet the token's first entry before. Rows that are handled at once.
FEW, DENSE, ROWS = 96, 16, 1 << 17
#: More entries than FEW meet in blocks of so many rows and pairs, if that leaves at most BLOCK_DENSE pairs for each.
BLOCK_ROWS, BLOCK, BLOCK_DENSE = 256, 1 << 18, 4
MEET = "token long, doc long, at long, size long, y_doc long, y_at long, y_size long"


def _fit_arrays(size: np.ndarray, sigs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of the rows i and j (of one token) fit; the signatures leave few."""
    n, m = size[i] >> 32, size[j] >> 32
    out = _near(n, m, sigs, i, j)
    at = np.flatnonzero(out)
    mask = (1 << 32) - 1
    out[at] = _may(n[at], m[at], size[i[at]] & mask, size[j[at]] & mask)
    return out


def _fit_blocks(size: np.ndarray, sigs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i, j < i) of the rows of one token that fit; nothing if there are more than ``most``.

    Rows stand by length here, so a block meets only the shorter ones that the length filter allows. All lengths up to
    SHORT have one number as their signature, and longer ones meet them by both of theirs folded, as in ``_near``.
    """
    order = np.argsort(size >> 32, kind="stable")
    n, low, high = size[order] >> 32, sigs[0][order], sigs[1][order] if len(sigs) > 1 else np.zeros(len(order), np.int64)
    least, short = np.searchsorted(n, -(-n * NUM // DEN)), int(np.searchsorted(n, SHORT, side="right"))
    left, right, found, a = [], [], 0, 0
    while a < len(n):
        first = int(least[a])
        z = min(len(n), a + max(1, min(BLOCK_ROWS, BLOCK // (a - first + BLOCK_ROWS))))
        for k, end in ((first, min(short, z)), (max(first, short), z)):
            if k >= end:
                continue
            if end <= short:
                apart = np.bitwise_count(((low ^ high)[a:z, None] ^ low[None, k:end]).view(np.uint64))
            else:
                apart = sum(np.bitwise_count((s[a:z, None] ^ s[None, k:end]).view(np.uint64)) for s in (low, high))
            allowed = np.minimum((n[a:z, None] + n[None, k:end]) * (DEN - NUM) // (NUM + DEN), 255).astype(np.uint8)
            x, y = np.nonzero(apart <= allowed)
            x, y = x + a, y + k
            x, y = order[x[y < x]], order[y[y < x]]
            i, j = np.maximum(x, y), np.minimum(x, y)
            mask = (1 << 32) - 1
            fit = _may(size[i] >> 32, size[j] >> 32, size[i] & mask, size[j] & mask)
            left.append(i[fit])
            right.append(j[fit])
            found += len(left[-1])
            if found > most:
                return None
        a = z
    return np.concatenate(left), np.concatenate(right)


def _meet(batches):
    """From rows (token, doc, at, size, signatures), sorted by token: the pairs (no token) of tokens, and the rows of those
    of which too many pairs fit, with the token's first entry where it fits (of a token with more than ROWS, which never
    meets in pairs, the first of those that are handled first)."""
    held: list[np.ndarray] = []
    first = None  # of a token that goes on

    def run(rows: np.ndarray, more: bool):
        nonlocal first
        rows = rows[:, np.lexsort(rows[2::-1])]  # by place within a token; Spark sorts by one long faster than by three
        (token, doc, at, size), sigs = rows[:4], rows[4:]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        c = np.diff(np.append(start, len(token)))
        pos = np.arange(len(token)) - start[group]
        many = np.zeros(len(c), bool)
        lead = rows[:, start]
        if first is not None and first[0] == token[0]:
            lead[:, 0], many[0] = first, True
        if more:  # one token, of which more rows come
            many[:] = True
        first = lead[:, -1].copy()
        left, right, met = [], [], np.zeros(len(c), np.int64)
        for g in np.flatnonzero(~many & (c > FEW)):
            of = slice(start[g], start[g] + c[g])
            if (hits := _fit_blocks(size[of], sigs[:, of], BLOCK_DENSE * int(c[g]))) is None:
                many[g] = True
            else:
                left.append(hits[0] + start[g])
                right.append(hits[1] + start[g])
        i = np.flatnonzero((~many & (c <= FEW))[group])
        for lag in range(1, FEW):
            i = i[(pos[i] >= lag) & (met[group[i]] <= DENSE * c[group[i]])]
            if not len(i):
                break
            hit = i[_fit_arrays(size, sigs, i, i - lag)]
            if len(hit):
                met += np.bincount(group[hit], minlength=len(c))
                left.append(hit)
                right.append(hit - lag)
        many |= met > DENSE * c
        x, y = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (left, right))
        x, y = x[~many[group[x]]], y[~many[group[x]]]
        z = np.flatnonzero(many[group])
        of = lead[:, group[z]]
        k = np.arange(len(z))
        no_lead = ~_fit_arrays(np.concatenate([size[z], of[3]]), np.concatenate([sigs[:, z], of[4:]], axis=1), k, k + len(z)) | (doc[z] < of[1]) | ((doc[z] == of[1]) & (at[z] <= of[2]))
        both = np.concatenate([x, z])
        absent = np.arange(len(both)) < len(x)
        values = [pa.array(v[both], mask=None if k else absent) for k, v in enumerate(rows[:4])]
        values += [pa.array(np.concatenate([v[y], of[k + 1]]), mask=np.concatenate([np.zeros(len(x), bool), no_lead])) for k, v in enumerate((doc, at, size))]
        for a in range(0, len(both), ROWS):
            yield pa.RecordBatch.from_arrays([v.slice(a, ROWS) for v in values], ["token", "doc", "at", "size", "y_doc", "y_at", "y_size"])

    for b in batches:
        held.append(np.stack([c.to_numpy() for c in b.columns]))
        if sum(h.shape[1] for h in held) >= ROWS:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            held = [rows[:, cut:]] if cut else []
            yield from run(rows[:, :cut] if cut else rows, not cut)
    if held and (rows := np.concatenate(held, axis=1)).shape[1]:
        yield from run(rows, False)


PLACE = ("doc", "tie", "line")
#: Tokens of the sets of one side of a cell.
CELL = 1 << 19
MATCHED = "doc long, tie int, line int"


def _matched(cell: pa.Table) -> pa.Table:
    """Of a cell's rows (late, doc, tie, line, tokens) the late ones that an earlier one of the others reaches."""
    place = [cell[c].to_numpy() for c in PLACE]
    order = np.lexsort((~cell["late"].to_numpy(), *place[::-1]))
    cell = cell.take(pa.array(order))
    late = cell["late"].to_numpy()
    sets = cell["tokens"].combine_chunks()
    n = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(n)])
    tokens = sets.flatten().to_numpy()
    sigs = np.stack(_signatures(tokens.view(np.uint64), n))
    ids = np.unique(tokens, return_inverse=True)[1]
    own = np.zeros(int(ids.max()) + 1, np.int32)
    found = []
    for x in np.flatnonzero(late):
        y = np.flatnonzero(~late[:x])
        y = y[_near(n[x], n[y], sigs, np.full(len(y), x), y) & (n[x] * DEN >= n[y] * NUM) & (n[y] * DEN >= n[x] * NUM)]
        if len(y):
            own[ids[start[x]:start[x + 1]]] = 1
            first, end = y[0], y[-1] + 1
            shared = np.add.reduceat(own[ids[start[first]:start[end]]], start[first:end] - start[first])[y - first]
            own[ids[start[x]:start[x + 1]]] = 0
            if (shared * (NUM + DEN) >= (n[x] + n[y]) * NUM).any():
                found.append(x)
    return cell.take(pa.array(found, pa.int64())).select(list(PLACE))


def _unsettled(many: DataFrame, sets: DataFrame, settled: DataFrame) -> DataFrame:
    """(doc, tie, line) of the entries that are not settled and that an earlier one of a common token reaches.

    The entries of a token that are not settled and all of its entries are dealt out to blocks, by the tokens of their
    sets, and each block of the one meets each of the other in a cell.
    """
    rows = (many.select("token", "doc", _upper("at").alias("tie"), _lower("at").alias("line"), _upper("size").alias("n"))
            .join(settled.select("x.*").distinct().withColumn("gone", F.lit(True)), list(PLACE), "left").withColumn("late", F.col("gone").isNull()))
    blocks = lambda n: (F.floor(n / CELL) + 1).cast("int")
    by_token = (rows.groupBy("token").agg(blocks(F.sum("n")).alias("all_blocks"), blocks(F.sum(F.when(F.col("late"), F.col("n")).otherwise(0))).alias("late_blocks"),
                                          F.max("late").alias("any")).where("any").drop("any"))
    own = lambda b: F.pmod(F.xxhash64(*PLACE), b).cast("int")
    cells = lambda late, b, of: F.transform(F.sequence(F.lit(0), F.col(b) - 1), lambda k: of(k, F.lit(late).alias("late")))
    among = cells(False, "late_blocks", lambda k, late: F.struct(late, k.alias("x"), own("all_blocks").alias("y")))
    asks = cells(True, "all_blocks", lambda k, late: F.struct(late, own("late_blocks").alias("x"), k.alias("y")))
    return (rows.join(by_token, "token").withColumn("cell", F.explode(F.when(F.col("late"), F.concat(among, asks)).otherwise(among)))
            .select("token", "cell.x", "cell.y", "cell.late", *PLACE).join(sets, list(PLACE))
            .groupBy("token", "x", "y").applyInArrow(lambda cell: _matched(cell), MATCHED).distinct())


def _tie(text_col: str) -> Column:
    """Tells apart different texts of one id."""
    return F.shiftright(F.xxhash64(F.coalesce(text_col, F.lit(""))), 32).cast("int")


def find_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (null ids: the least number), tie, ``removed`` (numbers of the lines that go, in order)."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)).alias("doc"),
                    _tie(text_col).alias("tie"), F.coalesce(text_col, F.lit("")).alias("text"))

    def all_words(b):
        for _, _, data, starts in chunks(b.column(0)):
            yield words(data, starts)[1] >> np.uint64(64 - BITS)

    with shuffles_removed(spark):
        counts = hashed_counts(d.select("text"), all_words, RARITY_SLOTS, RARITY_ROWS)
    rarity = spark.sparkContext.broadcast(counts)  # of fixed size
    # equal sets are one entry, at their first place; lines at other places go, and a place that stands twice is one
    place = Window.partitionBy("hi", "lo").orderBy("again", *PLACE)
    lines = materialize(_entries(d, rarity).withColumns({"_rank": F.rank().over(place), "_row": F.row_number().over(place)})
                        .withColumn("again", F.col("again") | (F.col("_rank") > 1)).where("again OR _row = 1")
                        .select(*PLACE, "again", "n", *SIGS, F.when(~F.col("again"), F.col("tokens")).alias("tokens")))
    # each of an entry's prefix tokens is a row, and the rows of a token are brought together once
    pre = (lines.where("NOT again").select("doc", _two("tie", "line").alias("at"), "n", *SIGS, F.size("tokens").alias("c"), F.posexplode("tokens").alias("k", "token"))
           .withColumn("place", _prefix(F.col("n")) - F.col("c") + F.col("k"))
           .select("token", "doc", "at", _two("n", "place").alias("size"), *SIGS))
    both = materialize(pre.repartition("token").sortWithinPartitions("token").mapInArrow(_meet, MEET))
    few, many = both.where("token IS NULL").drop("token"), both.where("token IS NOT NULL")
    sets = _sets_at(d, many.select("doc", _upper("at").alias("tie"), _lower("at").alias("line")))
    settled = materialize(_verified(_candidates(many.where("y_at IS NOT NULL")), sets))
    pairs = materialize(_candidates(few))
    late = (settled.unionByName(_verified(pairs, _sets_at(d, pairs.select("x.*").unionByName(pairs.select("y.*"))))).select("x.*")
            .unionByName(_unsettled(many, sets, settled)))
    # a line stays if it is its set's first place and no earlier entry matches
    return (lines.where("again").select(*PLACE).unionByName(late)
            .groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line")).alias("removed")))


def _sets_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, tie, line, tokens) of the lines at some places."""
    keys = materialize(places.distinct())
    with shuffles_removed(docs.sparkSession):
        bits = hashed_bits(keys, lambda b: [_place_hash(*(c.to_numpy() for c in b.columns)), _text_hash(*(c.to_numpy() for c in b.columns[:2]))], MET_SLOTS)
    met = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size
    return materialize(_sets(docs, met).join(keys, list(PLACE), "left_semi").dropDuplicates(PLACE))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x): places of x in those of the pairs of places (x, y) whose token sets reach the threshold."""
    side = lambda s: sets.select(F.struct(*PLACE).alias(s), F.col("tokens").alias(f"{s}_tokens"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    same = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return both.where(same * (NUM + DEN) >= (F.size("x_tokens") + F.size("y_tokens")) * NUM).select("x")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with later matches taken out of the text, and with two more columns: ``n_lines``
    before and ``removed_lines`` (underscores are added to names that are taken)."""
    doc, tie, removed, n_lines = unused(docs, "doc", "tie", "removed_lines", "n_lines")
    found = find_lines(docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("removed").alias(removed))
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)), tie: _tie(text_col)})
    parts = F.split(text_col, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(removed, i)), "\n")
    return (keyed.join(found, [doc, tie], "left")
            .withColumn(n_lines, F.coalesce(F.size(parts), F.lit(0)))
            .withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(kept)).drop(doc, tie))


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: how many lines it has and which of them go (each has a link to an earlier line)."""
    found = find_lines(docs)
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("doc"),
                    _tie("text").alias("tie"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    n = F.coalesce(F.size("removed"), F.lit(0))
    return d.join(found, ["doc", "tie"], "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))
