"""Toxicity by the nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled documents of each class (EXAMPLES, drawn by hash) are the examples. Terms are all words of
the examples' whole texts, without punctuation; a term weighs (1 + log of its count) * idf * G, where idf is counted over
all documents and G is the log-likelihood ratio of the term's being spread unevenly over toxic and clean examples. Plain
TF-IDF finds texts on one topic and misses most toxic ones, as the README says with figures; no term is left out, but one
that tells the classes apart no better than chance weighs little. A document's nearest examples are found exactly with
a block-max inverted index: blocks of examples are visited by their best possible cosine until none left can reach the
k-th best so far. The examples vote by closeness, beside one vote of the classes' shares. Leaving each example out in
turn calibrates the votes by isotonic regression at the labels' true class sizes; a score is read from that line.

The model (arrays of terms and postings, as large as the examples' texts) is a file in the shared folder, which every
Python worker maps. One task makes it from the bounded examples; neither these nor their terms come to the driver.

Defined cases: null and empty texts, and texts without any term, get the share among examples without terms; an empty
documents table gives no rows; without labels every score is 0.25; of rows that repeat a labelled id the least text
stands for the label, and every repeated row is scored; a document labelled both ways counts as toxic; null labels and
ids are skipped, and a row without an id is scored; very long texts are scored whole, a megabyte at a time; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import crc_mod, let_go, put, scratch, table

#: Examples of each class, neighbours, and how many of these are given as evidence.
EXAMPLES, NEIGHBOURS, EVIDENCE = 2000, 15, 3
#: Examples of a block, blocks that are visited first (then four times as many, and so on), the share (one of so many) of examples that makes a term's list a row, and queries for which rows are multiplied at once.
BLOCK, VISIT, DENSE, QUERIES_AT_ONCE = 64, 8, 16, 64
#: Terms whose document frequencies travel in one row.
SLICE = 1 << 14


def term_counts(texts: list[str | None]) -> Iterator[tuple]:
    """For each text its distinct terms (signed 64-bit hashes, ascending) and how often each occurs."""
    import numpy as np

    from corvane.llm.wordhash import NOT_ALNUM, words

    for hashes, bounds in words(texts, NOT_ALNUM):
        signed = hashes.view(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(signed[a:b], return_counts=True)


def _spans(starts, ends):
    """All integers of the ranges, one range after another."""
    import numpy as np

    sizes = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Vectors with exact top-k search by dot product.

    Vectors are numbered so that alike ones share blocks. A term that one of DENSE vectors or more have is a row of a matrix,
    by which many queries are multiplied at once. Any other term has an entry for each block that holds it, with its greatest
    weight there and the range of its postings. A query visits blocks by their best possible product, the best first, until
    no block left can reach the k-th best so far."""

    ARRAYS = ("number", "row", "matrix", "entry_bounds", "entry_block", "entry_top", "entry_posting", "posting_at", "posting_weight")

    def __init__(self, arrays: dict, block: int):
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.block, self.blocks = block, -(-len(self.number) // block)
        self.matrix = self.matrix.reshape(-1, max(1, self.blocks * block))

    @staticmethod
    def build(owner, term, weight, vectors: int, terms: int, block: int = BLOCK, dense: int = DENSE) -> dict:
        """Arrays of the index over elements (vector, term from 0, positive weight)."""
        import numpy as np

        main = np.full(vectors, -1, np.int64)
        heavy = np.lexsort((term, weight, owner))
        main[owner[heavy]] = term[heavy]  # the last of an owner is its heaviest
        number = np.lexsort((np.arange(vectors), main))
        place = np.empty(vectors, np.int64)
        place[number] = np.arange(vectors)
        often = np.bincount(term, minlength=terms) * dense >= max(1, vectors)
        row = np.where(often, np.cumsum(often) - 1, -1)
        matrix, inside = np.zeros((int(often.sum()), max(1, -(-vectors // block) * block))), often[term]
        matrix[row[term[inside]], place[owner[inside]]] = weight[inside]
        owner, term, weight = owner[~inside], term[~inside], weight[~inside]
        order = np.lexsort((place[owner], term))
        at, term, weight = place[owner][order], term[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)))) if len(at) else np.zeros(0, np.int64)
        return {
            "number": number, "row": row, "matrix": matrix.reshape(-1), "entry_bounds": np.searchsorted(term[first], np.arange(terms + 1)), "entry_block": at[first] // block,
            "entry_top": np.maximum.reduceat(weight, first) if len(first) else np.zeros(0), "entry_posting": np.append(first, len(at)), "posting_at": at, "posting_weight": weight.astype(np.float64),
        }

    def search(self, queries: list[tuple], k: int, without: list[int] | None = None) -> Iterator[tuple]:
        """For each query (terms, weights) the k vectors with the greatest positive products, best first, of equal ones the lower
        numbers: products and numbers. without: a vector left out, of each query."""
        import numpy as np

        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries[at : at + QUERIES_AT_ONCE]
            weights = np.zeros((len(part), len(self.matrix)))
            for n, (terms, w) in enumerate(part):
                rows = self.row[terms]
                weights[n, rows[rows >= 0]] = w[rows >= 0]
            base = (weights @ self.matrix).reshape(len(part), -1, self.block) if self.blocks else np.zeros((len(part), 0, self.block))
            for n, (terms, w) in enumerate(part):
                yield self._search(terms, w, base[n], k, -1 if without is None else without[at + n])

    def _search(self, terms, weights, base, k: int, without: int):
        import numpy as np

        scores, numbers = np.zeros(0), np.zeros(0, np.int64)
        a, b = self.entry_bounds[terms], self.entry_bounds[terms + 1]
        entries, q = _spans(a, b), np.repeat(weights, b - a)
        blocks = self.entry_block[entries]
        bound = base.max(1, initial=0.0) + np.bincount(blocks, q * self.entry_top[entries], self.blocks) + 1e-9  # sums may differ in their last bits
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 2e-9]
        visit = np.empty(self.blocks, np.int64)
        visits = VISIT
        while len(order):
            now, order, visits = order[:visits], order[visits:], 4 * visits
            visit[:] = -1
            visit[now] = np.arange(len(now))
            own = visit[blocks] >= 0
            of, qs = entries[own], q[own]
            s, e = self.entry_posting[of], self.entry_posting[of + 1]
            postings = _spans(s, e)
            at = self.posting_at[postings]
            local = visit[at // self.block] * self.block + at % self.block
            sums = base[now].reshape(-1) + np.bincount(local, np.repeat(qs, e - s) * self.posting_weight[postings], len(now) * self.block)
            hit = np.flatnonzero(sums > (scores[-1] - 1e-9 if len(scores) == k else 1e-9))
            found = self.number[now[hit // self.block] * self.block + hit % self.block]
            keep = found != without
            scores, numbers = np.concatenate((scores, sums[hit[keep]])), np.concatenate((numbers, found[keep]))
            best = np.lexsort((numbers, -scores))[:k]
            scores, numbers = scores[best], numbers[best]
            if len(scores) == k:
                order = order[bound[order] >= scores[-1]]
        return scores, numbers


def isotonic(x, y, weights) -> tuple[list[float], list[float]]:
    """Increasing means of y by x, where neighbours that fall are pooled: the mean x and the mean y of each pool."""
    ties: dict[float, list[float]] = {}
    for a, b, w in zip(x, y, weights, strict=True):
        own = ties.setdefault(a, [0.0, 0.0])
        own[0] += b * w
        own[1] += w
    pools: list[list[float]] = []
    for a, (b, w) in sorted(ties.items()):
        pools.append([a * w, b, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


def unevenness(toxic, clean, n_toxic: int, n_clean: int):
    """Log-likelihood ratio of terms in so many of the toxic and clean examples."""
    import numpy as np

    def part(seen, of, both):
        told = seen > 0
        return np.where(told, seen * np.log(np.where(told, seen, 1) * (n_toxic + n_clean) / np.maximum(of * both, 1)), 0.0)

    both = toxic + clean
    rest = n_toxic + n_clean - both
    return np.maximum(0.0, 2 * (part(toxic, n_toxic, both) + part(clean, n_clean, both) + part(n_toxic - toxic, n_toxic, rest) + part(n_clean - clean, n_clean, rest)))


class Model:
    """Scores of texts, with evidence. Made of arrays and numbers, which a file holds."""

    def __init__(self, arrays: dict, told: dict, neighbours: int = NEIGHBOURS):
        self.arrays, self.told, self.k = arrays, told, neighbours
        self.terms, self.factors, self.ids, self.toxic = (arrays[n] for n in ("terms", "factors", "ids", "toxic"))
        self.index = BlockMaxIndex(arrays, int(told["block"]))
        self.path: str | None = None

    @staticmethod
    def fit(terms, factors, examples: list[tuple], class_sizes: tuple[int, int], neighbours: int = NEIGHBOURS, block: int = BLOCK) -> Model:
        """terms: ascending hashes, with idf * G of each. examples: (id, toxic, its terms, their counts). class_sizes: clean and toxic labels in all."""
        import numpy as np

        toxic = np.array([e[1] for e in examples], np.int64)
        arrays = {"terms": np.asarray(terms, np.int64), "factors": np.asarray(factors, np.float64), "ids": np.array([e[0] for e in examples], np.int64), "toxic": toxic}
        vectors = [Model._vector(arrays["terms"], arrays["factors"], e[2], e[3]) for e in examples]
        joined = [np.concatenate([np.zeros(0, kind), *(v[k] for v in vectors)]) for k, kind in ((0, np.int64), (1, np.float64))]
        owner = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        arrays |= BlockMaxIndex.build(owner, *joined, len(vectors), len(arrays["terms"]), block)
        drawn = [int((toxic == y).sum()) for y in (0, 1)]
        each = [class_sizes[y] / drawn[y] if drawn[y] else 0.0 for y in (0, 1)]
        prior = (class_sizes[1] + 0.5) / (sum(class_sizes) + 2)
        model = Model(arrays, {"block": block, "share": drawn[1] / max(1, sum(drawn)), "none": prior, "prior": prior}, neighbours)
        votes = [model.votes(*found) for found in model.index.search(vectors, model.k, list(range(len(vectors))))]
        told = [(v, y) for v, y in zip(votes, toxic.tolist(), strict=True) if v is not None]
        line = isotonic([v for v, _ in told], [float(y) for _, y in told], [each[y] for _, y in told])
        without = [sum(each[y] for v, t in zip(votes, toxic.tolist(), strict=True) if v is None and t == y) for y in (0, 1)]
        model.told["none"] = (without[1] + prior) / (sum(without) + 1)
        arrays["line_votes"], arrays["line_rates"] = np.array(line[0], np.float64), np.array(line[1], np.float64)
        return model

    @staticmethod
    def _vector(known, factors, terms, counts):
        """Places of terms and their weights, to length 1."""
        import numpy as np

        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        hit = (known[at] == terms) & (factors[at] > 0)
        at = at[hit]
        weights = (1 + np.log(counts[hit])) * factors[at]
        return at, weights / np.sqrt((weights * weights).sum()) if len(at) else weights

    def votes(self, cosines, numbers) -> float | None:
        import numpy as np

        if not len(cosines):
            return None
        weights = 1 / (1.05 - np.minimum(1.0, cosines))
        return float((weights[self.toxic[numbers] == 1].sum() + self.told["share"]) / (weights.sum() + 1))

    def scores(self, texts: list[tuple]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """For texts (terms, counts) the score, and (id, toxic, cosine) of the nearest examples, the nearest first."""
        import numpy as np

        line = self.arrays["line_votes"]
        for cosines, numbers in self.index.search([self._vector(self.terms, self.factors, *t) for t in texts], self.k):
            votes = self.votes(cosines, numbers)
            if votes is None:
                yield self.told["none"], []
                continue
            score = float(np.interp(votes, line, self.arrays["line_rates"])) if len(line) else self.told["prior"]
            yield min(1.0, max(0.0, score)), [(int(self.ids[n]), int(self.toxic[n]), min(1.0, float(c))) for c, n in zip(cosines, numbers, strict=True)]

    def packed(self) -> bytes:
        from corvane.llm.elias_fano import pack

        return pack(self.arrays, **self.told)

    def save(self, spark: SparkSession) -> str:
        """The model's file; one that came from a file is there already."""
        from corvane.llm.files import write_file

        if self.path is None:
            self.path = f"{scratch(spark, 'toxic-model')}/model"
            write_file(self.path, self.packed())
        return self.path

    @staticmethod
    def load(path: str) -> Model:
        """The worker's own copy; it keeps one model."""
        from corvane.llm.elias_fano import unpack
        from corvane.llm.files import map_file

        if path not in _loaded:
            _loaded.clear()
            _loaded[path] = Model(*unpack(map_file(path)))
            _loaded[path].path = path
        return _loaded[path]


_loaded: dict[str, Model] = {}


def _terms_of(rows: DataFrame) -> DataFrame:
    """id, toxic, terms and counts (as bytes) of rows (id, toxic, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            found = list(term_counts(batch["text"].tolist()))
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "terms": [t.tobytes() for t, _ in found], "counts": [n.tobytes() for _, n in found]})

    return rows.mapInPandas(count, "id bigint, toxic int, terms binary, counts binary")


def document_frequencies(docs: DataFrame, dictionary: str) -> DataFrame:
    """Rows (slice, df as bytes): how many rows of docs (text) hold each term of the dictionary's file, SLICE terms a row; in slice -1 how many rows there are."""
    import numpy as np

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corvane.llm.elias_fano import unpack
        from corvane.llm.files import map_file
        from corvane.llm.wordhash import NOT_ALNUM, words

        let_go()
        terms = unpack(map_file(dictionary))[0]["terms"]
        df, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += len(batch)
            for hashes, bounds in words(batch["text"].tolist(), NOT_ALNUM) if len(terms) else ():
                signed = hashes.view(np.int64)
                at = np.minimum(np.searchsorted(terms, signed), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == signed)
                text = np.searchsorted(bounds, hit, "right") - 1
                df += np.bincount(np.unique(text * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        yield pd.DataFrame({"slice": [-1], "df": [np.array([n]).tobytes()]})
        yield pd.DataFrame([(k, df[k : k + SLICE].tobytes()) for k in range(0, len(terms), SLICE)], columns=["slice", "df"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, object] = {}
        for batch in batches:
            for k, part in zip(batch["slice"], batch["df"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.int64)
        yield pd.DataFrame([(k, part.tobytes()) for k, part in sums.items()], columns=["slice", "df"])

    kind = "slice int, df binary"
    return docs.select("text").mapInPandas(count, kind).repartition("slice").mapInPandas(add, kind)


def _write_once(rows: DataFrame, path: str, made: Callable[[list[tuple]], bytes]) -> None:
    """One task makes the file of all rows, which are bounded by the examples. Files appear whole, so a lost task is run again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corvane.llm.files import write_file

        let_go()
        write_file(path, made([row for batch in batches for row in batch.itertuples(index=False, name=None)]))
        yield pd.DataFrame({"done": [True]})

    rows.repartition(1).mapInPandas(run, "done boolean").collect()


#: In the column toxic: a row of document frequencies, and the row that is there even if nothing else is.
_FREQUENCY, _MARK = -1, -2


def _examples(rows: list[tuple]) -> list[tuple]:
    import numpy as np

    return [(i, y, np.frombuffer(t, np.int64), np.frombuffer(n, np.int64)) for i, y, t, n in sorted(r for r in rows if r[1] >= 0)]


def _terms(held: list[tuple]):
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.int64), *(e[2] for e in held)]))


def _fitted(rows: list[tuple], sizes: tuple[int, int]) -> Model:
    """The model of rows (examples and document frequencies) and the numbers of clean and toxic labels."""
    import numpy as np

    held = _examples(rows)
    terms = _terms(held)
    seen = [np.bincount(np.searchsorted(terms, np.concatenate([np.zeros(0, np.int64), *(e[2] for e in held if e[1] == y)])), minlength=len(terms)) for y in (0, 1)]
    parts = {r[0]: np.frombuffer(r[2], np.int64) for r in rows if r[1] == _FREQUENCY}
    n_docs = int(parts[-1][0]) if parts else 0
    df = np.concatenate([parts[k] for k in range(0, len(terms), SLICE)]) if parts and len(terms) else np.zeros(len(terms), np.int64)
    idf = np.log((n_docs + 1) / (df + 0.5)) + 1
    g = unevenness(seen[1], seen[0], sum(e[1] for e in held), sum(1 - e[1] for e in held))
    return Model.fit(terms, idf * g, held, sizes)


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, examples: int = EXAMPLES) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. train: which ids may be learned from (of labels' doc_id)."""
    from corvane.llm.elias_fano import pack

    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(train) if train is not None else known
    known = put(known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max((F.col("toxic") >= 1).cast("int")).alias("toxic")), "toxic-labels")
    counted = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = counted.get(0, 0), counted.get(1, 0)
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (0, 1)]
    chosen = put(drawn[0].unionByName(drawn[1]), "toxic-chosen")  # at most 2 * examples rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = put(_terms_of(texts), "toxic-examples")  # the bounded sample
    root = scratch(spark, "toxic-model")
    dictionary, path = f"{root}/terms", f"{root}/model"
    row = lambda i, y, data: [i.cast("bigint").alias("id"), F.lit(y).alias("toxic"), data.alias("terms"), F.lit(None).cast("binary").alias("counts")]
    mark = spark.range(1).select(*row(F.col("id"), _MARK, F.lit(None).cast("binary")))
    _write_once(rows.unionByName(mark), dictionary, lambda told: pack({"terms": _terms(_examples(told))}))
    frequencies = put(document_frequencies(docs, dictionary), "toxic-frequencies").select(*row(F.col("slice"), _FREQUENCY, F.col("df")))
    _write_once(rows.unionByName(frequencies).unionByName(mark), path, lambda told: _fitted(told, sizes).packed())
    return Model.load(path)


def scorer(model: Model, spark: SparkSession, evidence: int = EVIDENCE):
    """A Column function: text -> struct of score and evidence, the nearest examples."""
    path, kind = model.save(spark), "score double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>"

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        own = Model.load(path)
        for texts in batches:
            told = []
            for part in batched(term_counts(texts.tolist()), QUERIES_AT_ONCE):
                told += [(s, [{"doc_id": i, "toxic": y, "cosine": c} for i, y, c in near[:evidence]]) for s, near in own.scores(list(part))]
            yield pd.DataFrame(told, columns=["score", "evidence"])
        _loaded.clear()  # the file is mapped again in no time, and later stages need the memory
        let_go()

    return F.pandas_udf(score, kind)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, with docs' own columns."""
    return docs.filter(scorer(fit(docs, labels), docs.sparkSession, 0)(F.col("text"))["score"] < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(model, spark)(F.col("text")).alias("_s"))
    return scored.select("doc_id", "held_out", F.col("_s.score").alias("score"), (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), F.col("_s.evidence").alias("evidence"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_toxicity": op4_toxicity}
