"""Evaluation prompts that also stand, exactly or almost, in the training split.

Every evaluation prompt is normalised and cut into disjoint passages of three words. The prompts
are dealt by length into shards of bounded size; for each shard an Aho-Corasick automaton over its
passages, with words as its letters, scans every training prompt of fitting length. The matched
intervals of one evaluation prompt are merged into its coverage by that training prompt. A prompt of
n words that differs from one of m words in at most max(n, m) / 5 words keeps at least
(passages - max(n, m) / 5) passages, so a coverage below that can't belong to a pair; the others are
verified word by word. Of a prompt that must keep k of its p passages, the p - k + 3 rarest hold 3 of
those kept (all, if k is less): only these are counted, and the common ones looked at afterwards.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words of a passage.
PASSAGE = 3
#: Share of the longer prompt's words that may differ.
DIFFER = 5  # a fifth
#: Characters of evaluation prompts in a shard and of training prompts in a block, on average.
SHARD_CHARS, BLOCK_CHARS = 24_000_000, 48_000_000
#: Fewer training prompts than make so many blocks are dealt into smaller ones, of so many characters at least.
LEAST_BLOCKS, LEAST_CHARS = 8, 1_000_000
#: Of the passages that a pair must keep, so many are looked for among the rarest ones.
RARE = 3
#: Pairs of a prompt and a text that are counted at once.
CELLS = 1 << 18
#: Bits that tell which words a prompt holds: the commonest words have one each, all others share the last 64.
WORD_BITS = 512
#: Share of a prompt's distinct words that may be missing, slips included, before words are paired.
MISSING = 3  # a third

#: Number words.
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    " sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_JOINERS = regex.compile(r"['’]|\p{Cf}|\p{M}")
_DIGITS = regex.compile(r"(?<=\d)(?=\p{L})|(?<=\p{L})(?=\d)")


def spell_number(word: str) -> list[str]:
    """Words of a whole number below 100; other words stay."""
    if not (word.isascii() and word.isdigit()) or int(word) > 99:
        return [word]
    n = int(word)
    if n < 20:
        return [UNITS[n]]
    return [TENS[n // 10 - 2]] + ([UNITS[n % 10]] if n % 10 else [])


#: ASCII letters in lower case and digits; all other ASCII characters part words, but for the apostrophe.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else None if chr(i) == "'" else " " for i in range(128)}


@lru_cache(maxsize=100_000)
def _pieces(word: str) -> tuple[str, ...]:
    return tuple(x for piece in _DIGITS.split(word) for x in spell_number(piece))


def words_of(text: str) -> list[str]:
    """Words without case, accents, punctuation; numerals below 100 spelled out."""
    if not text.isascii():
        text = _JOINERS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    words = text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)
    return [x for word in words for x in ((word,) if word.isalpha() else _pieces(word))]


def passages_of(words: list[str]) -> list[tuple[int, int]]:
    """Disjoint word intervals that cover the prompt, of ``PASSAGE`` words, the last ones longer."""
    n = len(words)
    k = max(1, n // PASSAGE)
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def is_slip(a: str, b: str) -> bool:
    """One word is the other with a letter or two added, dropped, changed or swapped."""
    allowed = 1 if max(len(a), len(b)) < 8 else 2
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > allowed:
        return False
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, old = old, row
    return old[-1] <= allowed


def differing(a: list[str], b: list[str]) -> int:
    """Words of the longer prompt without a partner in the other, slips being partners."""
    held, other = Counter(a), Counter(b)
    only_a, only_b = list((held - other).elements()), list((other - held).elements())
    more = max(len(a), len(b))
    if max(len(only_a), len(only_b)) > more // 2:
        return max(len(only_a), len(only_b))
    matched = 0
    for x in only_a:
        for k, y in enumerate(only_b):
            if is_slip(x, y):
                del only_b[k]
                matched += 1
                break
    return max(len(only_a) - matched, len(only_b))


def _least(n_words: np.ndarray, n_passages: np.ndarray, other: int) -> np.ndarray:
    """Passages that must be found; a tenth of them more may be lost, to slips beside other changes."""
    return np.maximum(1, n_passages - np.maximum(n_words, other) // DIFFER - n_passages // 10)


class Shard:
    """Automaton over the passages of some evaluation prompts, given as normalised words."""

    def __init__(self, prompts: list[str]) -> None:
        import ahocorasick

        self.order = sorted(range(len(prompts)), key=lambda i: prompts[i].count(" "))
        self.prompts = [prompts[i] for i in self.order]
        n_held = Counter(w for p in self.prompts for w in set(p.split()))
        self.codes = {w: k for k, (w, _) in enumerate(n_held.most_common())}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.n_words = np.array([p.count(" ") + 1 for p in self.prompts], np.int64)
        self.n_passages = np.maximum(1, self.n_words // PASSAGE)
        self.n_distinct = np.empty(len(prompts), np.int64)
        self.bits = np.zeros((len(prompts), WORD_BITS // 64), np.uint64)
        own = WORD_BITS - 64
        # the bit of each word; the last place is for words that no prompt has
        self.bit = np.array([k if k < own else own + k % 64 for k in range(len(self.codes))] + [WORD_BITS])
        self.first = np.concatenate([[0], np.cumsum(self.n_passages)])
        self.passage = np.empty(self.first[-1], np.int64)
        ids: dict[tuple[int, ...], int] = {}
        at = 0
        for e, prompt in enumerate(self.prompts):
            codes = [self.codes[w] for w in prompt.split()]
            for i, j in passages_of(codes):
                self.passage[at] = ids.setdefault(tuple(codes[i:j]), len(ids))
                at += 1
            self.n_distinct[e] = len(set(codes))
            self.bits[e] = self._bits(np.zeros(len(codes), np.int64), codes, 1)[0]
        for codes, k in ids.items():
            self.automaton.add_word(codes, k)
        if ids:
            self.automaton.make_automaton()
        # the prompts of the passages, passage by passage, and how rare each passage is within its prompt
        owner = np.repeat(np.arange(len(prompts)), self.n_passages)
        often = np.bincount(self.passage, minlength=len(ids))
        by_rarity = np.lexsort((often[self.passage], owner))
        rank = np.empty(len(owner), np.int64)
        rank[by_rarity] = np.arange(len(owner)) - self.first[owner]
        by_passage = np.argsort(self.passage, kind="stable")
        self.owner, self.rank, self.of = owner[by_passage], rank[by_passage], self.passage[by_passage]
        self.n_ids = len(ids)

    def _bits(self, row: np.ndarray, codes: list[int], rows: int) -> np.ndarray:
        held = np.zeros((rows, WORD_BITS + 1), bool)
        held[row, self.bit[codes]] = True
        return np.packbits(held[:, :WORD_BITS], axis=1, bitorder="little").view(np.uint64)

    def _rare(self, level: int) -> None:
        """Rare passages of the prompts that fit texts of ``level`` * DIFFER words and a few more that change no bound."""
        least_m, most_m = level * DIFFER, level * DIFFER + DIFFER - 1
        # |n - m| * DIFFER <= max(n, m) for some m of the level
        fits = (self.n_words * DIFFER >= least_m * (DIFFER - 1)) & (self.n_words * (DIFFER - 1) <= most_m * DIFFER)
        self.low, self.high = (int(np.argmax(fits)), len(fits) - int(np.argmax(fits[::-1]))) if fits.any() else (0, 0)
        least = _least(self.n_words, self.n_passages, most_m)
        self.needs = np.minimum(least, RARE)
        chosen = (self.rank < (self.n_passages - least + self.needs)[self.owner]) & (self.owner >= self.low) & (self.owner < self.high)
        self.rare = self.owner[chosen] - self.low
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.of[chosen], minlength=self.n_ids))])
        self.needs = self.needs[self.low : self.high]

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, float, int]]:
        """(text, prompt, covered share of its passages, differing words) of each pair with ``texts``, normalised words."""
        words = [text.split() for text in texts]
        by_length = sorted(range(len(texts)), key=lambda i: len(words[i]))
        for level, group in groupby(by_length, key=lambda i: len(words[i]) // DIFFER):
            self._rare(level)
            if self.low == self.high:
                continue
            same = list(group)
            step = max(1, CELLS // (self.high - self.low))
            for k in range(0, len(same), step):
                yield from self._scan([(i, words[i]) for i in same[k : k + step]])

    def _scan(self, texts: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, float, int]]:
        codes = [tuple(map(self.codes.get, words, repeat(len(self.codes)))) for _, words in texts]
        hits = [{k for _, k in self.automaton.iter(c)} for c in codes]
        flat = np.fromiter(chain.from_iterable(hits), np.int64)
        begin, size = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        ends, width = np.cumsum(size), self.high - self.low
        if not len(ends) or not ends[-1]:
            return
        owner = self.rare[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]
        row = np.repeat(np.arange(len(texts)), [len(h) for h in hits])
        counts = np.bincount(np.repeat(row * width, size) + owner, minlength=len(texts) * width)
        row, some = np.nonzero(counts.reshape(len(texts), width) >= self.needs)
        some += self.low
        length = np.array([len(c) for c in codes])
        n, m = self.n_words[some], length[row]
        fits = np.abs(n - m) * DIFFER <= np.maximum(n, m)
        row, some = row[fits], some[fits]
        held = self._bits(np.repeat(np.arange(len(texts)), length), list(chain.from_iterable(codes)), len(texts))
        missing = np.bitwise_count(self.bits[some] & ~held[row]).sum(axis=1)
        fits = missing * MISSING <= self.n_distinct[some]
        for r, e in zip(row[fits].tolist(), some[fits].tolist()):
            i, words = texts[r]
            covered = sum(k in hits[r] for k in self.passage[self.first[e] : self.first[e + 1]].tolist())
            if covered < _least(self.n_words[e], self.n_passages[e], len(words)):
                continue
            own = self.prompts[e].split()
            distinct = frozenset(own)
            if len(distinct.difference(words)) * MISSING > len(distinct):
                continue
            d = differing(own, words)
            if d * DIFFER <= max(len(own), len(words)):
                yield i, self.order[e], covered / int(self.n_passages[e]), d


_SCHEMA = "eval_table string, item_id bigint, pair_id bigint, origin string, coverage double, n_differ int"


def _pairs(key: tuple, prompts: pa.Table, texts: pa.Table) -> pa.Table:
    rows = []
    if prompts.num_rows and texts.num_rows:
        shard = Shard(prompts.column("words").to_pylist())
        tables, items = prompts.column("eval_table").to_pylist(), prompts.column("item_id").to_pylist()
        # texts of like length follow each other
        for part in texts.sort_by("n_words").to_batches(max_chunksize=20_000):
            pairs, origins = part.column("pair_id").to_pylist(), part.column("origin").to_pylist()
            rows += [(tables[e], items[e], pairs[i], origins[i], c, d) for i, e, c, d in shard.scan(part.column("words").to_pylist())]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _normalised(df: DataFrame) -> DataFrame:
    """``df`` with ``words`` (normalised, parted by spaces) and ``n_words`` in place of ``prompt``; rows without a word are left out."""
    kept = [c for c in df.columns if c != "prompt"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [words_of(p) for p in part.column("prompt").to_pylist()]
            columns = [part.column(c) for c in kept]
            columns += [pa.array([" ".join(w) for w in found], pa.string()), pa.array([len(w) for w in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "words", "n_words"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in kept]
    return df.mapInArrow(batches, ", ".join([*kinds, "words string", "n_words int"])).where("n_words > 0")


def _cuts(prompts: DataFrame, chars: int) -> list[float]:
    """Borders of the shards: numbers of words, with fractions where one number fills several shards."""
    sizes = prompts.groupBy("n_words").agg(F.sum(F.length("words") + 50).alias("chars")).orderBy("n_words").collect()
    shards = max(1, -(-sum(r.chars for r in sizes) // chars))
    each = sum(r.chars for r in sizes) / shards
    cuts, before = [], 0
    for r in sizes:
        while len(cuts) < shards - 1 and before + r.chars >= each * (len(cuts) + 1):
            cuts.append(r.n_words + (each * (len(cuts) + 1) - before) / r.chars)
        before += r.chars
    return cuts


def _blocks(texts: DataFrame, chars: int) -> int:
    """How many blocks of about ``chars`` characters the texts make."""
    total = texts.agg(F.sum(F.length("prompt") + 50)).first()[0] or 0
    return max(1, -(-total // chars), min(LEAST_BLOCKS, total // LEAST_CHARS))


def overlaps(evaluation: DataFrame, training: DataFrame, shard_chars: int = SHARD_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All pairs of ``evaluation`` (eval_table, item_id, prompt) and ``training`` (pair_id, origin, prompt).

    Columns: eval_table, item_id, pair_id, origin, coverage (share of the evaluation prompt's
    passages found in the training prompt), n_differ (words of the longer prompt that have no
    partner). Null and blank prompts and prompts without a letter or digit pair with nothing.
    Repeated prompts under several ids pair id by id; a row repeated whole gives its pair once.
    Every shard of evaluation prompts meets every block of training prompts; shards and blocks
    are cut by length and by a hash of the row, so that repeated prompts don't gather in one. Empty tables give
    no rows; other columns are ignored.
    """
    seen = F.regexp_replace("prompt", r"[^\p{L}\p{N}]", "") != ""
    prompts = evaluation.select("eval_table", F.col("item_id").cast("bigint").alias("item_id"), "prompt").where(seen)
    texts = training.select(F.col("pair_id").cast("bigint").alias("pair_id"), F.col("origin").cast("string").alias("origin"), "prompt").where(seen)
    n_blocks = _blocks(texts, block_chars)
    prompts, texts = _normalised(prompts), _normalised(texts)
    cuts = _cuts(prompts, shard_chars)
    after = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    shard_at = lambda place: F.size(F.filter(after, lambda c: c <= place))
    within = F.pmod(F.xxhash64("eval_table", "item_id", "words"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    prompts = prompts.withColumn("shard", shard_at(F.col("n_words") + within))
    # a fifth of the longer one's words may be missing from the shorter
    least, most = F.floor(F.col("n_words") * (DIFFER - 1) / DIFFER), F.floor(F.col("n_words") * DIFFER / (DIFFER - 1)) + 1
    texts = texts.withColumn("block", F.pmod(F.xxhash64("pair_id", "words"), F.lit(n_blocks)).cast("int"))
    prompts = prompts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    texts = texts.withColumn("shard", F.explode(F.sequence(shard_at(least.cast("double")), shard_at(most.cast("double")))))
    # so many parts that few tasks get two groups
    n_parts = 4 * n_blocks * (len(cuts) + 1)
    left, right = (df.repartition(n_parts, "shard", "block").groupBy("shard", "block") for df in (prompts, texts))
    return left.cogroup(right).applyInArrow(_pairs, _SCHEMA).distinct()


def suites(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Evaluation prompts of several tables as one."""
    found = None
    for name, df in tables:
        part = df.select(F.lit(name).alias("eval_table"), "item_id", "prompt")
        found = part if found is None else found.unionByName(part)
    return found


def overlap_report(pairs: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Pairs, evaluation prompts hit and their share per suite and origin (null origin kept)."""
    size = evaluation.groupBy("eval_table").agg(F.count("*").alias("n_items"))
    found = pairs.groupBy("eval_table", "origin").agg(
        F.count("*").alias("n_pairs"),
        F.count_distinct("item_id").alias("n_items_hit"),
        F.count_if(F.col("n_differ") == 0).alias("n_same_words"),
    )
    return found.join(F.broadcast(size), "eval_table").withColumn("share_hit", F.round(F.col("n_items_hit") / F.col("n_items"), 6))
