"""Mining of collocations with double-array tries over all text positions at once.

Words are counted first; those that are frequent in their language get numbers, and every text
becomes a row of word numbers with a zero wherever a phrase cannot go on (a rare word, the end
of a piece). Then one pass over the numbers for each phrase length L: the frequent phrases of
L words are a double-array trie, broadcast to all tasks, and all positions advance their
states together, one array operation a level. A bincount of the accepting states gives the
occurrences of the phrases of L words; shards of the texts are summed. In the same pass, the
positions where a phrase of L words is accepted here and at the next word tell which phrases
of L + 1 words may be frequent at all (Apriori): the pairs of accepting state and next word
that occur often enough are the candidates of the next pass's trie.

No more than ``TRIE`` phrases, or ``VOCABULARY`` words, are broadcast at a time; more of them
take further passes.

Defined cases: null and empty texts have no words; a null language is "und"; words of one text
never join those of the next; overlapping occurrences count; rows are texts of their own,
whatever their doc_id and however often they repeat; texts and words of any length are read
whole; an empty table gives no rows; columns other than lang and text are ignored. Ties of
score and count go by the phrase's bytes. Counts are exact integers, products of them
decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import LOWER, UPPER, forget, small_batches, stored, table
from trawl.llm.spans import byte_table, gathered, groups, lowered, owners, sizes_of, spans

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Most words, and phrases, that are broadcast for one pass.
VOCABULARY, TRIE = 1 << 20, 1 << 19
#: Texts handed to a worker at a time, at most.
ROWS = 1000
_BREAKS = [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]
BREAK = np.isin(np.arange(256), _BREAKS)
SEPARATORS = BREAK | byte_table((9, 9), (32, 32))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and their texts' numbers."""
    raw, begins = sizes_of(column)
    raw = lowered(raw)
    starts, ends = spans(raw, begins, SEPARATORS)
    return raw, starts, ends, owners(begins, starts)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches, 1, 1 << 22):
        raw, starts, ends, owner = _words(batch.column(1))
        if not len(starts):
            continue
        langs = batch.column(0).dictionary_encode()
        words = gathered(raw, starts, ends).dictionary_encode()
        key = words.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()[owner]
        found, n = np.unique(key, return_counts=True)
        lang = langs.dictionary.take(pa.array(found % len(langs.dictionary)))
        word = words.dictionary.take(pa.array(found // len(langs.dictionary))).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([lang, word, pa.array(n, pa.int64())], names=["lang", "word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; stored."""
    counts = docs.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession, ROWS):
        return stored(counts.select("lang", F.col("word").cast("string").alias("word"), "n"), "words")


def dense(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored with ``num``, from 1 without gaps."""
    out = stored(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    base, bases = 1, []
    for r in out.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per partition
        bases.append((r.part, base))
        base += r.n
    bases = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    numbers = out.join(bases, F.shiftright("_at", 33) == F.col("_part")).withColumn("num", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")
    numbers.stored_at = out.stored_at
    numbers.many = base - 1
    return numbers


def _encoder(words: pa.Table, last: bool):
    """Puts the numbers of these words into the texts' rows of numbers."""
    by_lang = {}
    for lang in pc.unique(words.column("lang")).to_pylist():
        own = words.filter(pc.equal(words.column("lang"), lang))
        by_lang[lang] = own.column("word").combine_chunks().cast(pa.large_binary()), own.column("num").to_numpy().astype(np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 1):
            raw, starts, ends, owner = _words(batch.column(1))
            earlier = batch.column(2)
            langs = batch.column(0).dictionary_encode()
            of, ids = langs.indices.to_numpy()[owner], np.zeros(len(starts), np.int32)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                if lang in by_lang:
                    values, numbers = by_lang[lang]
                    at = np.flatnonzero(of == k)
                    found = pc.fill_null(pc.index_in(gathered(raw, starts[at], ends[at]), values), -1).to_numpy()
                    ids[at[found >= 0]] = numbers[found[found >= 0]]
            # A zero after each word at the end of its piece, so after a text's last one, too.
            breaks = np.cumsum(BREAK[raw])[starts]
            ends_piece = np.ones(len(starts), bool)
            ends_piece[:-1] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
            place = np.arange(len(starts)) + np.cumsum(ends_piece) - ends_piece
            out = np.zeros(len(starts) + int(ends_piece.sum()), np.int32)
            out[place] = ids
            begins = np.append(place, len(out))[np.searchsorted(owner, np.arange(batch.num_rows + 1))]
            known, _ = sizes_of(earlier)
            if len(known):
                out = np.maximum(out, known.view(np.int32))
            if last:
                keep = np.ones(len(out), bool)
                keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
                keep[begins[:-1][begins[:-1] < len(out)]] = True
                begins = np.concatenate([[0], np.cumsum(keep)])[begins]
                out = out[keep]
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * begins).astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([rows], names=["ids"]) if last else pa.RecordBatch.from_arrays([*batch.columns[:2], rows], names=["lang", "text", "ids"])

    return run


def encoded(docs: DataFrame, words: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """(ids): each text as little-endian 32-bit word numbers, 0 where phrases end; stored."""
    rows, before = docs.withColumn("ids", F.lit(None).cast("binary")), None
    waves = max(1, -(-words.many // most))
    for wave in range(waves):
        own = words.filter(F.col("num").between(wave * most + 1, (wave + 1) * most)).select("lang", "word", "num").toArrow()
        last = wave == waves - 1
        with small_batches(docs.sparkSession, ROWS):
            rows = stored(rows.mapInArrow(_encoder(own, last), "ids binary" if last else "lang string, text string, ids binary"), "numbers")
        if before is not None:
            forget(before)
        before = rows
    return rows


class Trie:
    """A double-array trie of phrases of one length: the child of state ``s`` by word number
    ``w`` is the state ``base[s] + w`` if its ``check`` is ``s``."""

    def __init__(self, phrases: np.ndarray, largest: int):
        """``phrases``: different rows of word numbers from 1 to ``largest``."""
        self.depth = phrases.shape[1]
        order = np.lexsort(phrases.T[::-1])
        rows = phrases[order]
        # The nodes of each level, from the root: parent's number in its level, and word.
        differ = np.zeros(len(rows), bool)
        if len(rows):
            differ[0] = True
        of = np.zeros(len(rows), np.int64)  # each phrase's node on the level above
        levels = []
        for d in range(self.depth):
            differ[1:] |= rows[1:, d] != rows[:-1, d]
            first = np.flatnonzero(differ)
            levels.append((of[first], rows[first, d].astype(np.int64)))
            of = np.cumsum(differ) - 1
        self._place(levels, largest)
        self.phrase = np.full(len(self.base), -1, np.int64)
        self.phrase[self._states] = order
        del self._states

    def _place(self, levels: list[tuple[np.ndarray, np.ndarray]], largest: int) -> None:
        parents, words, at, above = [], [], 1, 0
        for parent, word in levels:  # numbers over all levels, the root is node 0
            parents.append(parent + above)
            words.append(word)
            above, at = at, at + len(word)
        parent, word = np.concatenate(parents), np.concatenate(words)
        bases = fit(parent, word, largest, at)
        # States level by level: a child's is its parent's base and its own word.
        state = np.zeros(at, np.int64)
        size = int(bases.max(initial=0)) + largest + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[0] = bases[0]
        low = 1
        for p, w in zip(parents, words, strict=True):
            own = slice(low, low + len(w))
            state[own] = bases[p] + w
            self.base[state[own]] = bases[own]
            self.check[state[own]] = state[p]
            low += len(w)
        self._states = state[low - len(words[-1]) : low]

    def accepted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in ``ids``, and which ones."""
        padded = np.concatenate([ids, np.zeros(self.depth, ids.dtype)])
        at = np.flatnonzero(ids)
        state = np.zeros(len(at), np.int32)
        for d in range(self.depth):
            following = self.base[state] + padded[at + d]
            alive = self.check[following] == state
            at, state = at[alive], following[alive]
        return at, self.phrase[state]


def fit(parent: np.ndarray, word: np.ndarray, largest: int, nodes: int) -> np.ndarray:
    """A base for each node, so that no two children of any nodes share a place.

    ``parent`` (ascending) and ``word`` are those of all children. Nodes of many children are
    placed one by one while there is room, the others together: all try places at random, and
    those that meet no other stay.
    """
    rng = np.random.default_rng(11)
    first = np.searchsorted(parent, np.arange(nodes))
    many = np.diff(np.append(first, len(parent)))
    base = np.zeros(nodes, np.int64)
    room = 2 * len(parent) + 1
    used = np.zeros(room + largest + 1, bool)

    def grow() -> None:
        nonlocal used, room
        used = np.concatenate([used, np.zeros(room, bool)])
        room *= 2

    for k in np.flatnonzero(many > 4)[np.argsort(-many[many > 4], kind="stable")].tolist():
        own = word[first[k] : first[k] + many[k]]
        if many[k] <= 64:
            tries = rng.integers(0, room, 64)
            free = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
        else:
            tries = rng.integers(0, room, 8)
            free = [i for i in range(8) if not used[tries[i] + own].any()][:1]
        while not len(free):
            end = int(np.flatnonzero(used)[-1]) + 1
            while end > room:
                grow()
            tries, free = [end], [0]
        base[k] = tries[free[0]]
        used[base[k] + own] = True
    for size in range(4, 0, -1):
        todo = np.flatnonzero(many == size)
        while len(todo):
            tries = rng.integers(0, room, len(todo))
            places = tries[:, None] + word[first[todo][:, None] + np.arange(size)]
            free = ~used[places].any(axis=1)
            claim = np.full(len(used), -1, np.int64)
            who = np.flatnonzero(free)
            claim[places[who]] = who[:, None]
            won = who[(claim[places[who]] == who[:, None]).all(axis=1)]
            base[todo[won]] = tries[won]
            used[places[won]] = True
            if len(won) < len(todo) // 16:
                grow()
            todo = np.delete(todo, won)
    return base


def _pass(trie: Trie, low: int, alone: bool, last: bool):
    """(num, word, n): occurrences of each phrase (word 0), and of each with the next word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(num: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(num.astype(np.int64)), pa.array(word.astype(np.int32)), pa.array(n.astype(np.int64))], names=["num", "word", "n"])

        size = len(trie.phrase) if not len(trie.phrase) else int(trie.phrase.max()) + 1
        sums = np.zeros(size, np.int64)
        for batch in groups(batches, 0, 1 << 22):
            raw, _ = sizes_of(batch.column(0))
            ids = np.frombuffer(raw.tobytes(), np.int32)
            at, phrase = trie.accepted(ids)
            sums += np.bincount(phrase, minlength=size)
            if last or not len(at):
                continue
            following = np.append(ids, np.zeros(trie.depth, np.int32))[at + trie.depth]
            open_ = following > 0
            if alone:  # else the next word's phrase may be in another pass's trie
                here = np.zeros(len(ids) + 1, bool)
                here[at] = True
                open_ &= here[at + 1]
            found, n = np.unique(phrase[open_] << 32 | following[open_], return_counts=True)
            yield rows((found >> 32) + low, found & 0xFFFFFFFF, n)
        held = np.flatnonzero(sums)
        yield rows(held + low, np.zeros(len(held)), sums[held])

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, vocabulary: int = VOCABULARY, most: int = TRIE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``max_words`` words with ``min_count``
    occurrences or more, and (lang, n), the number of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = word_counts(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    level = dense(counts.filter(F.col("n") >= min_count).select("lang", "word").orderBy("lang", "word"), "vocabulary")
    words = level.select("num", "lang", "word")
    words.many = level.many
    texts = encoded(docs, words, vocabulary)
    level = level.select("num", "lang", F.col("word").alias("phrase"), F.array(F.col("num").cast("int")).alias("ids"))
    level.many = words.many
    found, spark = None, docs.sparkSession
    for length in range(1, max_words + 1):
        waves, parts = -(-level.many // most), None
        for wave in range(waves):
            low = wave * most + 1
            rows = level.filter(F.col("num").between(low, low + most - 1)).select("num", "ids").toArrow()
            order = np.argsort(rows.column("num").to_numpy())
            ids = rows.column("ids").combine_chunks().flatten().to_numpy().reshape(-1, length)[order]
            one = texts.mapInArrow(_pass(Trie(ids, words.many), low, waves == 1, length == max_words), "num long, word int, n long")
            with small_batches(spark, ROWS):
                one = stored(one.groupBy("num", "word").agg(F.sum("n").alias("n")).filter((F.col("word") == 0) | (F.col("n") >= min_count)), "sums")
            parts = one if parts is None else parts.unionByName(one)
        if parts is None:
            break
        exact = parts.filter("word = 0").select("num", F.col("n").alias("f")).join(level, "num").select("lang", "phrase", F.lit(length).alias("words"), "f")
        exact = exact.filter(F.col("f") >= min_count)
        found = exact if found is None else found.unionByName(exact)
        if length < max_words:
            nexts = words.select(F.col("num").alias("word"), F.col("word").alias("following"))
            longer = parts.filter("word > 0").join(level, "num").join(nexts, "word")
            level = dense(longer.select("lang", F.concat_ws(" ", "phrase", "following").alias("phrase"), F.concat("ids", F.array("word")).alias("ids")), "phrases")
    if found is None:
        found = spark.createDataFrame([], "lang string, phrase string, words int, f long")
    return found, totals


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut."""
    found, totals = phrase_counts(docs, **options)
    found = stored(found, "counts")
    parts = F.split("phrase", " ")
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    long = found.filter("words > 1").withColumn("w", parts)
    f = lambda name, value: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = long.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": cut(F.lit(1), F.col("k")), "rest": cut(F.col("k") + 1, F.col("words") - F.col("k"))}).drop("w")
    cuts = cuts.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(CAST(1000 AS decimal(4,0)) * _a * _n) div (_l * _r)")
    cuts = cuts.withColumns({f"_{c}": big(c) for c in ("a", "n", "l", "r")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # Phrases inside a longer one that occurs as often.
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = long.filter("words > 2").select("lang", "f", "w", "words", F.explode(sizes).alias("size"))
    inner = inner.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LIKE = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LIKE}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m.size, unnest(list_transform(range(1, len(w) - m.size + 2), lambda i: array_to_string(w[i:i + m.size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS size) m WHERE len(w) >= m.size),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT f.*, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.size, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, 1000 * c.f * t.n // (x.f * y.f) AS score
      FROM c JOIN t ON c.lang = t.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT f.lang, f.f, string_split(phrase, ' ') AS w, size, unnest(range(2, size)) AS m FROM f WHERE size > 2),
j AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS o FROM i) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN j ON j.lang = b.lang AND j.phrase = b.phrase WHERE longer IS NULL OR longer < a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= {TOP}
"""
