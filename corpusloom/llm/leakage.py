"""Evaluation texts leaking into training text.

Corpus documents are cut into overlapping passages of words and weighted by term and inverse
passage frequency over the vocabulary of the test items (every other word cannot take part in a
leak and would only lower a passage's similarity). A randomised truncated SVD, fitted to the
passages of the whole corpus, gives the latent space; passages whose cosine with an item passes
a low bar are candidates. A candidate is then settled word by word: by the share of item words
inside repeated runs (copies), and by longest common subsequence and answer words (paraphrases).

The benchmark is the query set: it is taken in sets of at most SET_ITEMS items, which bounds the
vocabulary, the latent space and what is shipped to the workers. Texts are tokenised once, to the
numbers of the words that items have; documents are only mapped over, never moved or sorted.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.latent import pieces, times, truncated_svd
from corpusloom.session import cut

_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbfv])|(.))", re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|strike|sub|sup|tt|u|var)(?:\s[^<>]{0,300})?>", re.I)
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]{0,500}>")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] else m[4]


def plain_text(text: str) -> str:
    """Text without entities (nested ones too), backslash escapes, invisible characters and tags.
    Inline tags vanish, others part words."""
    for _ in range(3):
        if "&" not in text:
            break
        once = html.unescape(text)
        if once == text:
            break
        text = once
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits of the plain text, in lower case."""
    return _WORD.findall(plain_text(text).lower())


@dataclass
class Items:
    """The test items, prepared once on the driver. Null and repeated items are left out."""

    ids: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        out = cls()
        for key, text in sorted({r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}.items()):
            words = words_of(text)
            if words:
                out.ids.append(key)
                out.words.append(words)
                for w in words:
                    out.vocabulary.setdefault(w, len(out.vocabulary))
        return out


def windows(n: int, size: int, stride: int) -> list[tuple[int, int]]:
    """Passages of n words: whole text if short, else overlapping windows that reach its end."""
    if n <= size:
        return [(0, n)] if n else []
    starts = list(range(0, n - size, stride)) + [n - size]
    return [(a, a + size) for a in starts]


CODES = "doc_id long, codes array<int>"


def coded_words(items: Items):
    """Arrow map (doc_id, text) to CODES: the number of each word in the items' vocabulary, -1 for all
    others. Texts without any item word have no row."""
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [vocabulary.get(w, -1) for w in words_of(text)]
                if got and max(got) >= 0:
                    ids.append(key)
                    codes.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.list_(pa.int32()))], ["doc_id", "codes"])

    return run


def passages_of(codes: pa.Array, size: int, stride: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, row, word, value) of a list column of codes: passages with any item word,
    by the document's row and where they begin, and their entries 1 + ln tf in row order."""
    offsets = codes.offsets.to_numpy() - codes.offsets[0].as_py()
    flat = codes.flatten().to_numpy(zero_copy_only=False)
    doc, begin, spans = [], [], []
    for d in range(len(codes)):
        for a, b in windows(int(offsets[d + 1] - offsets[d]), size, stride):
            doc.append(d)
            begin.append(a)
            spans.append((offsets[d] + a, b - a))
    if not spans:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0)
    starts, lengths = np.array(spans).T
    row = np.repeat(np.arange(len(spans)), lengths)
    word = flat[np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)]
    at, tf = np.unique(row[word >= 0] * width + word[word >= 0], return_counts=True)
    row, word = at // width, at % width
    kept, row = np.unique(row, return_inverse=True)
    return np.array(doc)[kept], np.array(begin)[kept], row, word, 1 + np.log(tf)


def passage_rows(items: Items, size: int, stride: int):
    """Arrow map CODES to (grp, idx, val): one row a passage with any item word."""
    width = max(1, len(items.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, _, row, word, val = passages_of(batch.column(1), size, stride, width)
            ends = np.searchsorted(row, np.arange(len(doc) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (word.astype(np.int32), val.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int32)), *lists], ["grp", "idx", "val"])

    return run


def features(words: list[str], vocabulary: dict[str, int]) -> tuple[list[int], list[float]]:
    """Sparse 1 + ln tf of the words that the vocabulary has."""
    counts = Counter(vocabulary[w] for w in words if w in vocabulary)
    keys = sorted(counts)
    return keys, [1.0 + float(np.log(counts[k])) for k in keys]


def grams(codes: np.ndarray, run: int) -> np.ndarray:
    """Number of each run of `run` consecutive item words; -1 where one of them is no item word."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(run):
        part = codes[k : k + n].astype(np.int64)
        # A wrapping hash: two different runs of a set of items agree once in 2^64.
        out = out * np.int64(0x100000001B3) + (part + 1) * np.int64(0x9E3779B1)
        known &= part >= 0
    return np.where(known, out, -1)


def coverage(item: np.ndarray, known: np.ndarray, run: int = 4) -> float:
    """Share of item words inside runs of at least `run` consecutive item words whose every
    `run`-gram the document has; `item` are the item's grams in order, `known` the document's."""
    n = len(item) + run - 1
    hit = np.isin(item, known)
    covered = np.zeros(n, bool)
    for k in range(run):
        covered[k : k + len(item)] |= hit
    return float(covered.sum()) / n if len(item) else 0.0


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    row = 0
    for w in b:
        m = masks.get(w, 0)
        x = row | m
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def answer_words(item: list[str], rare: set[str]) -> set[str]:
    """Words that carry an item's facts: numbers, and words few items have."""
    return {w for w in item if w.isdigit() or w in rare}


@dataclass
class Model:
    """Latent space of the item vocabulary: weight of each word and its projection."""

    weights: np.ndarray
    basis: np.ndarray
    items: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(passages: DataFrame, items: Items, rank: int = 64) -> Model:
    """Weights and latent space from all passages. No word is dropped for being frequent: an item
    that leaked into a third of all documents makes its own words frequent. With no passages at
    all the items' own rows stand for the corpus."""
    width = len(items.vocabulary)
    counted = passages.selectExpr("explode(idx) AS w").groupBy("w").count().collect()  # a row a word of the items
    n = passages.count()
    df = np.zeros(width)
    for r in counted:
        df[r["w"]] = r["count"]
    weights = np.log(1 + max(n, 1) / np.maximum(df, 1))
    spark_weights = weights.astype(np.float32)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column("idx")
            lengths = np.diff(idx.offsets.to_numpy())
            flat = idx.flatten().to_numpy(zero_copy_only=False)
            val = batch.column("val").flatten().to_numpy(zero_copy_only=False) * spark_weights[flat]
            row = np.repeat(np.arange(len(lengths)), lengths)
            norm = np.sqrt(np.bincount(row, val * val, minlength=len(lengths)))
            val = (val / np.maximum(norm[row], 1e-9)).astype(np.float32)
            val = pa.ListArray.from_arrays(idx.offsets, pa.array(val))
            out = pa.RecordBatch.from_arrays([batch.column("grp"), idx, val], ["grp", "idx", "val"])
            yield out.filter(pa.array(norm > 0))

    weighted = passages.mapInArrow(weigh, "grp int, idx array<int>, val array<float>")
    own = [features(w, items.vocabulary) for w in items.words]
    got = truncated_svd(weighted, {0: width}, min(rank, max(1, width)), iterations=2)
    # Items' own directions complete the space: without a leak the corpus may not span them.
    dense = np.zeros((len(own), width))
    for r, (i, v) in enumerate(own):
        dense[r, i] = np.asarray(v) * weights[i]
    dense = _unit(dense)
    basis = got[0][0] if 0 in got else np.zeros((width, 0))
    residue = dense - (dense @ basis) @ basis.T
    _, s, vt = np.linalg.svd(residue, full_matrices=False)
    basis = np.hstack([basis, vt[s > 1e-6][:rank].T])
    return Model(weights, basis, _unit(dense @ basis))


def search(items: Items, model: Model, size: int, stride: int, bar: float, run: int, low_lcs: float):
    """Arrow map CODES to candidates with their cosine, coverage, subsequence share and answer share.
    The last two are looked at, and else 0, where the item and the passage share enough words for a
    subsequence of low_lcs."""
    share = Counter(w for words in items.words for w in set(words))
    rare = {w for w, c in share.items() if c <= max(2, len(items.ids) // 50)}
    number = items.vocabulary
    own = [np.array([number[w] for w in words]) for words in items.words]
    own_grams = [grams(c, run) for c in own]
    counts = [Counter(c.tolist()) for c in own]
    answers = [{number[w] for w in answer_words(words, rare)} for words in items.words]
    ids, width = np.array(items.ids), max(1, len(number))
    scaled = model.weights[:, None] * model.basis

    def settled(codes: np.ndarray, known: np.ndarray, k: int, begin: int) -> tuple[float, float, float]:
        covered = coverage(own_grams[k], known, run)
        near = codes[max(0, begin - stride) : begin + size + stride]
        near = near[near >= 0].tolist()
        common = sum((Counter(near) & counts[k]).values())
        if common < low_lcs * len(own[k]):
            return covered, 0.0, 0.0
        got = len(answers[k] & set(near)) / len(answers[k]) if answers[k] else 0.0
        return covered, lcs(own[k].tolist(), near) / len(own[k]), got

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, begin, row, word, val = passages_of(batch.column(1), size, stride, width)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for piece in pieces(row, len(doc)):
                found, latent_rows = times(row[piece], word[piece], val[piece], scaled)
                cos = _unit(latent_rows) @ model.items.T
                i, k = np.nonzero(cos >= bar)
                for p, q, c in zip(found[i].tolist(), k.tolist(), cos[i, k].tolist(), strict=True):
                    at = (int(doc[p]), q)
                    if at not in best or c > best[at][0]:
                        best[at] = (c, int(begin[p]))
            codes, keys = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            rows, last, flat, known = [], -1, None, None
            for (d, k), (c, a) in sorted(best.items()):
                if d != last:
                    last, flat = d, codes[d].values.to_numpy(zero_copy_only=False)
                    known = np.unique(grams(flat, run))
                    known = known[known != -1]
                rows.append((keys[d], ids[k], c, *settled(flat, known, k, a)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "cosine", "coverage", "lcs", "answers"])

    return run_


#: Items that are searched for together.
SET_ITEMS = 10_000
PAIRS = "doc_id long, item_id long, cosine double, coverage double, lcs double, answers double"


def item_sets(benchmark: DataFrame) -> Iterator[Items]:
    """The items in sets of at most SET_ITEMS."""
    rows = benchmark.select("item_id", "text").dropna().groupBy("item_id").agg(F.max("text").alias("text"))
    sets = max(1, -(-rows.count() // SET_ITEMS))
    for i in range(sets):
        mine = rows if sets == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == i)
        items = Items.of([tuple(r) for r in mine.collect()])
        if items.ids:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 64, size: int = 64, stride: int = 32, bar: float = 0.4, run: int = 4, low_lcs: float = 0.5) -> DataFrame:
    """(doc_id, item_id, cosine, coverage, lcs, answers) of every candidate pair; repeated rows
    count once. Null texts and ids are left out; an empty benchmark or corpus has no rows."""
    texts = docs.select("doc_id", "text").dropna()
    found = docs.sparkSession.createDataFrame([], PAIRS)
    for items in item_sets(benchmark):
        codes = cut(texts.mapInArrow(coded_words(items), CODES), "item-words")
        passages = cut(codes.mapInArrow(passage_rows(items, size, stride), "grp int, idx array<int>, val array<float>"), "passages")
        model = fit(passages, items, rank)
        found = found.unionByName(codes.mapInArrow(search(items, model, size, stride, bar, run, low_lcs), PAIRS))
    return found.dropDuplicates(["doc_id", "item_id"])


def copied(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id): at least `share` of the item's words lie in repeated runs."""
    return pairs.where(pairs.coverage >= share).select("doc_id", "item_id")


def paraphrased(pairs: DataFrame, share: float = 0.5, min_lcs: float = 0.5, min_answers: float = 0.6) -> DataFrame:
    """Pairs below the copy bar whose words keep the item's order and that state its facts."""
    return pairs.where((pairs.coverage < share) & (pairs.lcs >= min_lcs) & (pairs.answers >= min_answers))
