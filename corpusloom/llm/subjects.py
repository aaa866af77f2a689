"""Subject areas of documents.

Own sentences are taken from each document (not headings, code, logs, quoted excerpts or test
items), and documents are embedded by term weighting and a truncated singular value decomposition
for each language, since words of different languages share no space. Labelled documents give a
seed centroid for every area and language; sentences are assigned to the nearest centroid by
cosine, and the centroids are moved to the mean of their sentences, several times. A document is
about the areas that hold at least a given share of those of its own sentences that are about any
area; stock remarks ("see the notes below") are about none.

A language's vocabulary are the words in at least LEAST_DOCS documents, at most MAX_WORDS of them,
those in most documents. All statistics are sums formed in the cluster; only areas x rank numbers
and the vocabulary return to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm import latent
from corpusloom.llm.leakage import Items, item_sets
from corpusloom.session import cut

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = (
    ("en", "the and of to is it that for was with on are not this be at we you has from one"),
    ("de", "der die das und ist nicht ein zu mit für auf von bei wird den im auch dem eine des"),
    ("fr", "la le les et des est une dans pour que pas sur avec du au ce il nous aux par"),
    ("es", "el la los las y es una en para que no con del se por lo al entre su como"),
)
LANGUAGES = [name for name, _ in FUNCTION_WORDS]
_SETS = [frozenset(w.split()) for _, w in FUNCTION_WORDS]
_LANGUAGES_OF: dict[str, tuple[int, ...]] = {w: tuple(k for k, known in enumerate(_SETS) if w in known) for known in _SETS for w in known}
LEAST_DOCS, MAX_WORDS = 3, 50_000
#: A sentence with this share of its words inside runs of RUN test item words is quoted.
QUOTED, RUN = 0.5, 4
#: (cosine, lead) a sentence needs while the centroids settle, and afterwards.
STRICT, FINAL = (0.35, 0.1), (0.22, 0.05)

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)")
_EXCERPT = re.compile(r"--- \S+:\d+-\d+ \(similarity")
_HEADING = re.compile(r"#{1,6}\s|={3,}|-{3,}|<h[1-6]")
_LOG = re.compile(r"\[?\d{1,2}:\d{2}|(?:note|error|warning|info|debug)\b[^.]{0,40}:.*`|-->\s|[{<\[]\s*[\"a-zA-Z]+.*[}>\]]\s*$")
_LEAD = re.compile(r"^(?:(?:[-*+>]|\d+[.)])\s+|\[\w+\]\s+|\w+(?:\([\w./-]+\))?!?:\s+)+")
_STOP = re.compile(r"(?<=[.?!])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+")


def repaired(text: str) -> str:
    """Undo UTF-8 that was read as Latin-1, where that gives valid text."""
    if "\u00c3" in text or "\u00c2" in text:
        return re.sub(r"[\u00c2-\u00f4][\u0080-\u00bf]+", _repair, text)
    return text


def _repair(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


class Runs(frozenset):
    """Runs of words, with the words that occur in them."""

    @cached_property
    def words(self) -> frozenset[str]:
        return frozenset(w for run in self for w in run)


def item_runs(items: Iterable[Items]) -> Runs:
    """All runs of RUN consecutive words (letters only, as sentences have them) of the test items."""
    out = set()
    for part in items:
        for words in part.words:
            plain = [w for w in words if not any(c.isdigit() for c in w)]
            out.update(zip(*(plain[k:] for k in range(RUN)), strict=False))
    return Runs(out)


def quoted(words: list[str], runs: Runs) -> bool:
    """Whether QUOTED of a sentence's words lie in runs that a test item has. Most sentences do not have
    so many words of items at all."""
    known = runs.words
    if len(words) < RUN or sum(w in known for w in words) < QUOTED * len(words):
        return False
    upto = covered = 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(RUN)), strict=False)):
        if gram in runs:
            covered += i + RUN - max(upto, i)
            upto = i + RUN
    return covered >= QUOTED * len(words)


def own_sentences(text: str, runs: Runs) -> list[list[str]]:
    """Word lists of a document's own sentences. A sentence ends with a stop, question or
    exclamation mark and is not quoted from a test item."""
    text = _FENCE.sub("\n", repaired(text).replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if not s or _HEADING.match(s) or _EXCERPT.match(s) or _LOG.match(s):
            continue
        for part in _STOP.split(_LEAD.sub("", s)):
            if not part.rstrip("\"')]* ").endswith((".", "?", "!")):
                continue
            words = _WORD.findall(part.lower())
            if len(words) < 2 or quoted(words, runs):
                continue
            out.append(words)
    return out


def language(sentences: list[list[str]]) -> int:
    """Index of the language with the most function words; the first of equals."""
    hits = [0] * len(_SETS)
    for s in sentences:
        for w in s:
            for k in _LANGUAGES_OF.get(w, ()):
                hits[k] += 1
    return int(np.argmax(hits))


SENTENCES = "doc_id long, grp int, words array<string>, lens array<int>"


def _sentence_rows(runs: Runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, words, lens = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = own_sentences(text, runs)
                if s:
                    ids.append(key)
                    groups.append(language(s))
                    words.append([w for x in s for w in x])
                    lens.append([len(x) for x in s])
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, groups, words, lens), kinds, strict=True)], ["doc_id", "grp", "words", "lens"])

    return run


def _indexed(vocab: list[list[str]], idf: list[np.ndarray]):
    """Arrow map from SENTENCES to word numbers, with the document's unit tf-idf row. Words that the
    vocabulary does not have are left out of their sentences. Whole batches at a time."""
    known = [pa.array(v, pa.string()) for v in vocab]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                yield one(batch.filter(pa.array(groups == g)), int(g))

    def one(part: pa.RecordBatch, g: int) -> pa.RecordBatch:
        words, lens = part.column("words"), part.column("lens")
        coded = words.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, known[g]).fill_null(-1).to_numpy(zero_copy_only=False)
        code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(part.num_rows), np.diff(words.offsets.to_numpy()))
        sizes = lens.flatten().to_numpy(zero_copy_only=False)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        keep = code >= 0
        left = np.bincount(sentence[keep], minlength=len(sizes)).astype(np.int32)
        code, doc = code[keep], doc[keep]
        width = max(1, len(vocab[g]))
        at, tf = np.unique(doc * width + code, return_counts=True)
        row, idx = at // width, at % width
        val = (1 + np.log(tf)) * idf[g][idx] if len(idx) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, val * val, minlength=part.num_rows))
        val = val / np.where(norm[row] > 0, norm[row], 1)
        ends = lambda rows: pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends(row), pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(ends(row), pa.array(val.astype(np.float32))), pa.ListArray.from_arrays(ends(doc), pa.array(code.astype(np.int32)))]
        counts = pa.ListArray.from_arrays(pa.array((lens.offsets.to_numpy() - lens.offsets[0].as_py()).astype(np.int32)), pa.array(left))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grp"), *lists, counts], ["doc_id", "grp", "idx", "val", "words", "lens"])

    return run


INDEXED = "doc_id long, grp int, idx array<int>, val array<float>, words array<int>, lens array<int>"


def sentence_vectors(words: np.ndarray, lens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum of the word vectors of each sentence; sentences may be empty."""
    out = np.zeros((len(lens), vectors.shape[1]), vectors.dtype)
    ends = np.cumsum(lens)
    full = lens > 0
    if full.any():
        out[full] = latent.by_column(vectors, words, None, (ends - lens)[full])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 1e-12, norm, 1)


SENTENCE_VECTORS = "doc_id long, grp int, n int, data binary"


def _sentence_vectors(vectors: dict[int, np.ndarray]):
    """Arrow map INDEXED to SENTENCE_VECTORS: the number of a document's sentences and their vectors in half
    precision, computed once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in (int(x) for x in np.unique(groups) if int(x) in vectors):
                part = batch.filter(pa.array(groups == g))
                lens = part.column("lens")
                sums = sentence_vectors(part.column("words").flatten().to_numpy(zero_copy_only=False), lens.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vectors[g])
                n = np.diff(lens.offsets.to_numpy())
                raw = np.ascontiguousarray(sums.astype(np.float16))
                offsets = (np.concatenate(([0], np.cumsum(n))) * raw.shape[1] * 2).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grp"), pa.array(n.astype(np.int32)), data], ["doc_id", "grp", "n", "data"])

    return run


def _parts(batch: pa.RecordBatch, vectors: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(group, document of each sentence, sentence vectors, rows) of a batch of SENTENCE_VECTORS."""
    groups = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in (int(x) for x in np.unique(groups) if int(x) in vectors):
        part = batch.filter(pa.array(groups == g))
        doc = np.repeat(np.arange(part.num_rows), part.column("n").to_numpy(zero_copy_only=False))
        sums = np.frombuffer(b"".join(part.column("data").to_pylist()), np.float16).reshape(-1, vectors[g].shape[1]).astype(np.float32)
        yield g, doc, sums, part


def _sums(vectors: dict[int, np.ndarray], k: int, pick):
    """Arrow map that adds up, for each group, `pick(group, doc, sentence vectors, rows)` -> (area
    of each sentence or -1, vectors to add)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {g: np.zeros((k, m.shape[1] + 1)) for g, m in vectors.items()}
        for batch in batches:
            for g, doc, sums, part in _parts(batch, vectors):
                area, add = pick(g, doc, sums, part)
                keep = area >= 0
                chosen = (area[keep] == np.arange(k)[:, None]).astype(np.float32)
                acc[g][:, :-1] += chosen @ add[keep]
                acc[g][:, -1] += chosen.sum(1)
        yield latent.block_rows([(g, 0, 0, a.tobytes()) for g, a in acc.items() if a[:, -1].any()])

    return run


def _collect(rows: DataFrame, run, k: int) -> dict[int, np.ndarray]:
    return {g: flat.reshape(k, -1) for g, (_, flat) in latent.add_up(rows.mapInArrow(run, latent.SCHEMA)).items()}


def assign(unit: np.ndarray, centroids: np.ndarray, low: float, margin: float) -> np.ndarray:
    """Area of each sentence: the nearest centroid, or -1 below the bar, without a lead over the
    second, or where the last row, the centroid of stock remarks, is nearest."""
    cos = unit @ centroids.T.astype(unit.dtype)
    best = cos.argmax(1)
    top, second = np.take_along_axis(cos, best[:, None], 1)[:, 0], np.partition(cos, -2, axis=1)[:, -2]
    return np.where((top > low) & (top - second > margin) & (best < len(centroids) - 1), best, -1)


def _centroids(sums: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """Unit centroids from sums and counts: of the areas, less their common mean, and in the last
    row of the sentences about none. Rows without sentences keep their old centroid."""
    count = sums[:, -1:]
    mean = np.where(count > 0, sums[:, :-1] / np.maximum(count, 1), 0)
    have = count[:, 0] > 0
    areas = have & (np.arange(len(sums)) < len(sums) - 1)
    if areas.any():
        mean[areas] -= mean[areas].mean(0)
    out = _unit(mean)
    if old is not None:
        out[~have] = old[~have]
    return out


def subject_areas(
    docs: DataFrame, areas: DataFrame, labels: DataFrame, benchmark: DataFrame, share: float = 0.22, rounds: int = 5
) -> DataFrame:
    """(doc_id, area). `areas` is the fixed list of areas. Null texts, ids and labels, and labels
    of unknown areas, are left out; repeated rows count once. Documents without own sentences
    and languages without any label have no rows; so has an empty corpus."""
    spark = docs.sparkSession
    names = sorted(r[0] for r in areas.select("area").distinct().collect() if r[0] is not None)
    k = len(names)
    runs = item_runs(item_sets(benchmark))
    sents = cut(docs.select("doc_id", "text").dropna().mapInArrow(_sentence_rows(runs), SENTENCES), "sentences")
    sizes = {r["grp"]: r["count"] for r in sents.groupBy("grp").count().collect()}
    counts = sents.select("grp", F.explode(F.array_distinct("words")).alias("w")).where(F.length("w") > 1).groupBy("grp", "w").count()
    place = F.row_number().over(W.partitionBy("grp").orderBy(F.col("count").desc(), "w"))
    known = counts.where(F.col("count") >= LEAST_DOCS).withColumn("place", place).where(F.col("place") <= MAX_WORDS).collect()
    known = sorted((r["grp"], r["w"], r["count"]) for r in known)
    vocab = [[w for h, w, _ in known if h == g] for g in range(len(LANGUAGES))]
    idf = [np.array([np.log(1 + sizes[g] / c) for h, _, c in known if h == g]) if g in sizes else np.zeros(0) for g in range(len(LANGUAGES))]
    rows = cut(sents.mapInArrow(_indexed(vocab, idf), INDEXED), "indexed-sentences")
    got = latent.truncated_svd(rows.where(F.size("idx") > 0), {g: len(vocab[g]) for g in sizes}, rank=2 * k + 4, centred=True)
    vectors = {g: (basis * idf[g][:, None]).astype(np.float32) for g, (basis, _) in got.items()}
    if not vectors or not k:
        return spark.createDataFrame([], "doc_id long, area string")

    sent_rows = cut(rows.mapInArrow(_sentence_vectors(vectors), SENTENCE_VECTORS), "sentence-vectors")
    total = _collect(sent_rows, _sums(vectors, 1, lambda g, doc, sums, part: (np.zeros(len(doc), np.int64), sums)), 1)
    mean = {g: (t[0, :-1] / max(t[0, -1], 1)).astype(np.float32) for g, t in total.items()}
    number = {a: i for i, a in enumerate(names)}
    known_areas = F.create_map(*[x for a, i in number.items() for x in (F.lit(a), F.lit(i))])
    seeds = labels.select("doc_id", known_areas[F.col("area")].alias("label")).dropna().distinct()
    labelled = sent_rows.join(seeds, "doc_id")

    def seed(g: int, doc: np.ndarray, sums: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return part.column("label").to_numpy(zero_copy_only=False)[doc].astype(np.int64), _unit(sums - mean[g])

    centroids = {g: _centroids(s) for g, s in _collect(labelled, _sums(vectors, k + 1, seed), k + 1).items()}
    for step in range(rounds):
        bar = STRICT if step < rounds - 2 else FINAL
        now = dict(centroids)

        def move(g: int, doc: np.ndarray, sums: np.ndarray, part: pa.RecordBatch, now=now, bar=bar) -> tuple[np.ndarray, np.ndarray]:
            unit = _unit(sums - mean[g])
            area = assign(unit, now[g], *bar) if g in now else np.full(len(doc), -1)
            return np.where(area < 0, k, area), unit

        moved = _collect(sent_rows, _sums(vectors, k + 1, move), k + 1)
        centroids = {g: _centroids(moved[g], c) for g, c in now.items()}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for g, doc, sums, part in _parts(batch, vectors):
                if g not in centroids:
                    continue
                area = assign(_unit(sums - mean[g]), centroids[g], *FINAL)
                hits = np.zeros((part.num_rows, k))
                np.add.at(hits, (doc[area >= 0], area[area >= 0]), 1)
                d, a = np.nonzero((hits > 0) & (hits >= share * hits.sum(1, keepdims=True)))
                ids.extend(part.column("doc_id").to_numpy(zero_copy_only=False)[d].tolist())
                found.extend(names[i] for i in a)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "area"])

    return sent_rows.mapInArrow(decide, "doc_id long, area string").distinct()
