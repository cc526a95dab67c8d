"""Spelling variants by a variable-length gram index.

1. Words and their counts come from whole texts, added up in each task first.
2. The gram dictionary grows by length: a gram is extended only if it is more
   frequent than a threshold, which is set so that at most ``DICTIONARY`` grams pass
   it whatever the input.  From each place of a (bracketed) word starts one gram,
   which goes on while it is frequent and not longer than half of the word.  It
   depends on its own letters alone, so an edit changes just the grams it touches.
3. The affected-gram bound of a set of a word's grams is the most that one edit
   can touch.  A set with a bound below its size shares a gram with every near word,
   at the same distance from the start or the end.  For intervals the cheapest such
   set is the pair of grams that do not overlap with the least estimated lists; the
   word merges these lists and leaves its others alone.
4. Lists are keyed by gram, place and length.  A gram too frequent for its length
   limit is keyed by all that precedes it and by all that follows it, one of which
   the edit spares.  A list that still holds more than ``LIST`` words is dealt over
   several groups, and what probes it visits each.
5. Proposed pairs are verified letter by letter.

Words over ``LONG`` letters have two grams, their halves.  A word has a bounded
number of near words (letters times alphabet), so nothing is grouped without bound.

Defined cases: a null text has no words; a null doc_id counts as the empty text in
the hash; repeated rows count each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

DROP, LETTERS, COUNT, RATIO = 199, 6, 5, 5
SHORTEST, LONGEST = 2, 8   # letters of a gram
DICTIONARY = 200_000       # frequent grams at most, all lengths together
LONG = 48                  # letters of words that are indexed by their halves
LIST = 4096                # words of a list in one group
PAIRS = 1 << 18            # pairs verified at a time
HELD = 1 << 19             # counts a task holds before it passes them on
STRETCH = 1 << 20          # letters of a text cut into runs at a time
# Latin-1: letters A-Z in lower case, a-z and U+00C0 to U+00FF stay; all else parts runs
LETTER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
SAME, LONGER = 0, 2        # classes of pairs; a probe adds one


def runs(text: str) -> Counter:
    """Lower-cased runs of letters, a byte each, and their counts."""
    found: Counter = Counter()
    body = text.encode("latin-1", "replace").translate(LETTER_BYTES)
    at = 0
    while at < len(body):
        cut = body.find(b" ", at + STRETCH)
        cut = len(body) if cut < 0 else cut
        found.update(body[at:cut].split())
        at = cut
    return found


def _counted(source: DataFrame, count, label: str) -> DataFrame:
    """(key string, n) from ``count(batch, add)``, added up in bounded tables within a task, then by key."""

    def run(batches):
        held: dict[bytes, int] = {}

        def passed_on():
            keys = pa.array([k.decode("latin-1") for k in held], pa.string())
            out = pa.RecordBatch.from_arrays([keys, pa.array(list(held.values()), pa.int64())], [label, "n"])
            held.clear()
            return out

        for batch in batches:
            for part in count(batch):
                for key, n in part.items():
                    held[key] = held.get(key, 0) + n
                if len(held) >= HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    return source.mapInArrow(run, f"{label} string, n long").groupBy(label).agg(F.sum("n").alias("n"))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``LETTERS`` letters or more that occur ``COUNT`` times or more."""

    def count(batch):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            found: dict[bytes, int] = {}
            for run, n in runs(text.as_py()).items():
                size = len(run)
                if size < LETTERS:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % DROP == 0:
                    if size == LETTERS:
                        continue
                    gone = h % size
                    run = run[:gone] + run[gone + 1:]
                found[run] = found.get(run, 0) + n
            yield found

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return _counted(texts, count, "word").where(F.col("n") >= COUNT)


def limit_of(letters: int) -> int:
    """Longest gram in words of this many letters: two always fit side by side."""
    return min(LONGEST, (letters + 2) // 2)


def bracketed(word: bytes) -> bytes:
    return b"^" + word + b"$"


def dictionary(found: DataFrame) -> dict[bytes, int]:
    """Frequent grams and the number of their places; ``b""`` holds the threshold."""
    places = found.where(F.length("word") <= LONG).agg(F.sum(F.length("word") + 1)).first()[0] or 0
    threshold = max(8, -(-places * (LONGEST - SHORTEST + 1) // DICTIONARY))
    frequent: dict[bytes, int] = {b"": threshold}
    last = None
    for size in range(SHORTEST, LONGEST + 1):
        before = last

        def count(batch, size=size, before=before):
            for word in batch.column(0).to_pylist():
                if len(word) > LONG or size > limit_of(len(word)):
                    continue
                s = bracketed(word.encode("latin-1"))
                grams = (s[p:p + size] for p in range(len(s) - size + 1))
                yield Counter(g for g in grams if before is None or g[:-1] in before)

        rows = _counted(found.select("word"), count, "gram").where(F.col("n") > threshold).collect()
        last = {r.gram.encode("latin-1"): r.n for r in rows}
        frequent.update(last)
        if not last:
            break
    return frequent


def decomposed(s: bytes, limit: int, frequent) -> list[tuple[int, int]]:
    """(start, stop) of the gram from each place of a bracketed word."""
    out, n = [], len(s)
    for p in range(n - SHORTEST + 1):
        e = p + SHORTEST
        while e < n and e - p < limit and s[p:e] in frequent:
            e += 1
        out.append((p, e))
    return out


def affected(grams: list[tuple[int, int]]) -> int:
    """The most of these grams that one edit can touch."""
    return max((sum(p <= at < e for p, e in grams) for at, _ in grams), default=0)


def probes(s: bytes, grams: list[tuple[int, int]], frequent) -> list[tuple[int, int]]:
    """The cheapest grams with an affected bound below their number: two that do not overlap."""
    threshold = frequent[b""]

    def cost(p, e):
        n = frequent.get(s[p:e])
        return n if n is not None else min(threshold, frequent.get(s[p:e - 1], threshold)) / 4

    costs = [cost(p, e) for p, e in grams]
    right: list = [None] * (len(s) + 1)  # cheapest gram that starts there or later
    for k in range(len(grams) - 1, -1, -1):
        p = grams[k][0]
        right[p] = k if right[p + 1] is None or costs[k] <= costs[right[p + 1]] else right[p + 1]
    best = min(((costs[k] + costs[right[e]], k, right[e]) for k, (_, e) in enumerate(grams) if right[e] is not None))
    return [grams[best[1]], grams[best[2]]]


def _halves(s: bytes, shorter: int) -> list[tuple[int, int]]:
    """Of the bracketed form of a word that has ``shorter`` letters, or one more."""
    half = (shorter + 2) // 2
    return [(0, half), (len(s) - (shorter + 2 - half), len(s))]


def _key(kind: int, shorter: int, place: int, *parts: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%d,%d,%d|" % (kind, shorter, place) + b"|".join(parts))


def entries(word: bytes, frequent):
    """(shorter length, kind, key, crowded) of a word: its place in lists, and the lists it probes.

    ``crowded`` marks keys whose list may hold more than ``LIST`` words.
    """
    s, size = bracketed(word), len(word)
    made: dict[int, list] = {}
    for kind, shorter in ((SAME, size), (LONGER, size - 1)):
        limit = limit_of(shorter)
        if shorter > LONG:
            grams = _halves(s, shorter)
        else:
            grams = made.get(limit) or made.setdefault(limit, decomposed(s, limit, frequent))
        for p, e in grams:
            n = frequent.get(s[p:e], 0)
            if n:
                yield shorter, kind, _key(kind, shorter, p, b"<", s[:e]), n > LIST
                yield shorter, kind, _key(kind, shorter, p, b">", s[p:]), n > LIST
            else:
                yield shorter, kind, _key(kind, shorter, p, s[p:e]), shorter > LONG or frequent[b""] > LIST
    asked = _halves(s, size) if size > LONG else probes(s, made[limit_of(size)], frequent)
    for p, e in asked:
        n = frequent.get(s[p:e], 0)
        crowded = n > LIST or (not n and (size > LONG or frequent[b""] > LIST))
        if n:
            yield size, SAME + 1, _key(SAME, size, p, b"<", s[:e]), crowded
            yield size, SAME + 1, _key(SAME, size, p, b">", s[p:]), crowded
            # an insertion behind the gram leaves all before it; one ahead moves it and leaves all behind
            yield size, LONGER + 1, _key(LONGER, size, p, b"<", s[:e]), crowded
            yield size, LONGER + 1, _key(LONGER, size, p + 1, b">", s[p:]), crowded
        else:
            yield size, SAME + 1, _key(SAME, size, p, s[p:e]), crowded
            yield size, LONGER + 1, _key(LONGER, size, p, s[p:e]), crowded
            yield size, LONGER + 1, _key(LONGER, size, p + 1, s[p:e]), crowded


def indexed(found: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(shorter, key, kind, word, n): list entries and probes; lists that hold too many words are dealt over parts."""
    held = found.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_pylist()
            for at in range(0, len(values), 1024):
                rows = [(k, *entry) for k, w in enumerate(values[at:at + 1024], at) for entry in entries(w.encode("latin-1"), held.value)]
                who, shorter, kind, key, crowded = zip(*rows)
                place = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shorter, pa.int32()), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(kind, pa.int8()), pa.array(crowded),
                     batch.column(0).take(place), batch.column(1).take(place)], ["shorter", "key", "kind", "crowded", "word", "n"])

    rows = materialise(found.select("word", "n").mapInArrow(run, "shorter int, key long, kind byte, crowded boolean, word string, n long"), "entries")
    probing = F.col("kind") % 2 == 1
    sizes = rows.where("crowded").groupBy("key").agg(
        F.ceil(F.count(F.when(~probing, 1)) / LIST).cast("int").alias("rows"), F.ceil(F.count(F.when(probing, 1)) / (4 * LIST)).cast("int").alias("columns"))
    sizes = materialise(sizes.where("rows > 1 OR columns > 1"), "lists")
    told = rows.drop("crowded").join(sizes, "key", "left")
    # a grid of groups: an entry goes along its row, a probe along its column
    mine = F.pmod(F.xxhash64("word"), F.when(probing, F.col("columns")).otherwise(F.col("rows"))).cast("int")
    parts = (F.when(F.col("rows").isNull(), F.array(F.lit(0)))
             .when(F.when(probing, F.col("rows")).otherwise(F.col("columns")) < 1, F.array().cast("array<int>"))
             .when(probing, F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: r * F.col("columns") + mine))
             .otherwise(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: mine * F.col("columns") + c)))
    return told.select("shorter", "key", "kind", "word", "n", F.explode(parts).alias("part"))


def _near(kind: int, letters: int, probe: list[bytes], stored: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where probe ``a`` and stored ``b`` differ by one edit; of two words of one length the smaller probes."""
    if letters > LONG:
        out = np.zeros(len(a), dtype=bool)
        for k, (i, j) in enumerate(zip(a, b)):
            out[k] = _near(kind, min(letters, LONG), [probe[i]], [stored[j]], np.zeros(1, int), np.zeros(1, int))[0]
        return out
    x = np.frombuffer(b"".join(probe), dtype=np.uint8).reshape(len(probe), -1)[a]
    y = np.frombuffer(b"".join(stored), dtype=np.uint8).reshape(len(stored), -1)[b]
    rows, n = np.arange(len(a)), x.shape[1]
    if kind == SAME:
        apart = x != y
        first = apart.argmax(axis=1)
        return (apart.sum(axis=1) == 1) & (x[rows, first] < y[rows, first])
    head, tail = x != y[:, :n], (x != y[:, 1:])[:, ::-1]
    before = np.where(head.any(axis=1), head.argmax(axis=1), n)
    after = np.where(tail.any(axis=1), tail.argmax(axis=1), n)
    return before + after >= n


def _verified(shorter, key, kind, word, n):
    """(a, n_a, b, n_b) near pairs within whole lists; rows are ordered by (shorter, key)."""
    for letters in np.unique(shorter):
        for cls in (SAME, LONGER):
            stored = np.flatnonzero((shorter == letters) & (kind == cls))
            asking = np.flatnonzero((shorter == letters) & (kind == cls + 1))
            left = np.searchsorted(key[stored], key[asking], "left")
            count = np.searchsorted(key[stored], key[asking], "right") - left
            use = np.flatnonzero(count)
            if not len(use):
                continue
            asking, left, count = asking[use], left[use], count[use]
            probe, held = [word[i] for i in asking], [word[i] for i in stored]
            ends = np.cumsum(count)
            at, total = 0, int(ends[-1])
            while at < total:
                place = np.arange(at, min(at + PAIRS, total))
                who = np.searchsorted(ends, place, "right")
                other = left[who] + place - (ends[who] - count[who])
                good = np.flatnonzero(_near(cls, int(letters), probe, held, who, other))
                for i, j in {(int(i), int(j)) for i, j in zip(asking[who[good]], stored[other[good]])}:
                    yield word[i], n[i], word[j], n[j]
                at += len(place)


def near_pairs(found: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(a, n_a, b, n_b): each two near words once."""

    def run(batches):
        held = None

        def out(rows):
            pairs = list({(a, b): (a, x, b, y) for a, x, b, y in _verified(*rows)}.values())
            if pairs:
                a, x, b, y = zip(*pairs)
                text = [pa.array([w.decode("latin-1") for w in v], pa.string()) for v in (a, b)]
                yield pa.RecordBatch.from_arrays([text[0], pa.array(x, pa.int64()), text[1], pa.array(y, pa.int64())], ["a", "n_a", "b", "n_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(k).to_numpy() for k in (0, 1, 2, 4, 5)]
            text = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
            now = [*numbers[:3], text, *numbers[3:]]
            if held is None:
                held = now
            else:
                held = [h + x if isinstance(h, list) else np.concatenate([h, x]) for h, x in zip(held, now)]
            if len(held[0]) < 1 << 16:
                continue
            # the last list may go on in the next batch
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[5] == held[5][-1])
            whole = int(np.argmax(same))
            if whole:
                yield from out([h[:whole] for h in held[:5]])
                held = [h[whole:] for h in held]
        if held is not None:
            yield from out(held[:5])

    rows = indexed(found, frequent)
    # probes and list entries of one part of a list meet; parts of a list are told apart by the key
    rows = rows.withColumn("key", F.when(F.col("part") > 0, F.xxhash64("key", "part")).otherwise(F.col("key")))
    dealt = rows.select("shorter", "key", "kind", "word", "n", "part").repartition("shorter", "key", "part").sortWithinPartitions("shorter", "key", "part")
    return dealt.mapInArrow(run, "a string, n_a long, b string, n_b long").dropDuplicates(["a", "b"])


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the end of each chain, by doubling the steps; a step multiplies n by ``RATIO``, so chains are short."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        then = materialise(now.join(ahead, now["root"] == ahead["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        more = then.where("moved").limit(1).count()
        now = then.select("word", "root")
        if not more:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Per word: (word, form, root, n, n_near, form_n)."""
    ship_package(docs.sparkSession)
    found = materialise(words(docs.select("doc_id", "text")), "words")
    pairs = materialise(near_pairs(found, dictionary(found)), "pairs")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    told = found.join(best, "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
                       F.when(is_form, -F.col("best.less")).alias("form_n"))
    told = materialise(told, "forms")
    roots = rooted(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
