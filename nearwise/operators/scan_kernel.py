"""One task's share of an exact nearest-neighbour search, over Arrow batches.

Vectors are screened with a matrix product in single precision. Its rounding error has a known bound, so
every row that could still belong to the answer passes the screen; those rows are scored again in double
precision. No pair that fails the screen is ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUERY_ROWS = 512  # queries multiplied with a batch at a time
CORPUS_ROWS = 1024  # rows of a part multiplied with so many queries at a time: their products stay in a core's cache
RESCORE_VALUES = 1 << 18  # vector elements gathered at a time for exact scoring
FEWEST_WAITING = 4096  # pairs that are scored together at least


class QueryBlock(NamedTuple):
    """Queries as a matrix, with the columns to hand through to the result."""

    ids: np.ndarray
    vectors: np.ndarray
    carry: list[np.ndarray]
    facets: np.ndarray | None


class Task(NamedTuple):
    """What to search for."""

    k: int
    metrics: tuple[str, ...]
    digits: int | None
    n_corpus_carry: int
    prefilter: bool


def matrix_of(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the non-null vectors, and the vectors as a matrix.

    All vectors must have one length, as in any dense index; another length is an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.drop_null()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    width = dim if dim is not None else (int(sizes[0]) if len(sizes) else 0)
    if (sizes != width).any():
        raise ValueError(f"vectors must have {width} elements, found {sorted(set(sizes.tolist()))}")
    return rows, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def query_block(table: pa.Table, n_carry: int, prefilter: bool) -> QueryBlock:
    """Columns in order: id, vector, carried columns, facet key."""
    rows, vectors = matrix_of(table.column(1))
    kept = table.take(pa.array(rows))
    carry = [kept.column(2 + i).to_numpy(zero_copy_only=False) for i in range(n_carry)]
    facets = kept.column(2 + n_carry).to_numpy(zero_copy_only=False) if prefilter else None
    return QueryBlock(kept.column(0).to_numpy(), vectors.astype(np.float64), carry, facets)


def round_half_away(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Decimal rounding as SQL engines do it."""
    if digits is None:
        return values
    factor = 10.0**digits
    return np.copysign(np.floor(np.abs(values) * factor + 0.5) / factor, values)


class Best:
    """The k lowest (cost, id) rows seen so far for each query of a chunk."""

    def __init__(self, n_queries: int, k: int, n_carry: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.cost = np.empty(0, np.float64)
        self.doc = np.empty(0, np.int64)
        self.carry = [np.empty(0, object) for _ in range(n_carry)]
        self.bound = np.full(n_queries, np.inf)

    def offer(self, query, cost, doc, carry) -> None:
        query = np.concatenate([self.query, query])
        cost = np.concatenate([self.cost, cost])
        doc = np.concatenate([self.doc, doc])
        order = np.lexsort((doc, cost, query))
        ranked = query[order]
        place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked, side="left")
        order = order[place < self.k]
        last = place[place < self.k] == self.k - 1
        self.query, self.cost, self.doc = query[order], cost[order], doc[order]
        self.carry = [np.concatenate([old, new])[order] for old, new in zip(self.carry, carry)]
        self.bound[self.query[last]] = self.cost[last]


def scan(batches: Iterator[pa.RecordBatch], queries: QueryBlock, task: Task) -> Iterator[pa.RecordBatch]:
    """The best rows of all batches for every query and metric.

    Batch columns in order: id, vector, carried columns, then facet key and always-match flag. When prefiltering, the rows
    of a facet are multiplied with the queries that ask for it only; a query without a facet meets all rows.
    """
    n_queries, dim = queries.vectors.shape
    if not n_queries:
        return
    codes, query_codes = _facet_codes(queries.facets) if task.prefilter else (None, np.full(n_queries, UNASKED))
    chunks = []
    for code in np.unique(query_codes):
        asking = np.flatnonzero(query_codes == code)
        chunks += [(code, asking[at : at + QUERY_ROWS]) for at in range(0, len(asking), QUERY_ROWS)]
    best = {
        (at, metric): Best(len(chunk), task.k, task.n_corpus_carry)
        for at, (_, chunk) in enumerate(chunks)
        for metric in task.metrics
    }
    q_norm2 = np.einsum("ij,ij->i", queries.vectors, queries.vectors)
    for batch in batches:
        rows, x = matrix_of(batch.column(1), dim)
        if not len(rows):
            continue
        carried = batch.take(pa.array(rows))
        x_norm2 = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        finite = np.isfinite(x_norm2)
        if not finite.all():
            x, x_norm2, carried = x[finite], x_norm2[finite], carried.filter(pa.array(finite))
        docs, facet_at = carried.column(0).to_numpy(), 2 + task.n_corpus_carry
        kept = _without_surplus_copies(x, docs, x_norm2, carried, facet_at if task.prefilter else None, task.k)
        if kept is not None:
            docs, x, x_norm2, carried = docs[kept], x[kept], x_norm2[kept], carried.take(pa.array(kept))
        extra = [carried.column(2 + i).to_numpy(zero_copy_only=False) for i in range(task.n_corpus_carry)]
        precision = _screen_precision(x_norm2, q_norm2)
        if task.prefilter:
            row_codes, always = _row_facets(codes, carried, facet_at)
            present = {*row_codes.tolist(), UNASKED}
        last, x_screen = None, x.astype(precision, copy=False)
        for at, (code, chunk) in enumerate(chunks):
            if task.prefilter and code not in present and not always.any():
                continue
            if code != last:
                passing = slice(None) if code == UNASKED else np.flatnonzero((row_codes == code) | always)
                there, norm2, screen, last = x[passing], x_norm2[passing], x_screen[passing], code
            if not len(there):
                continue
            q = queries.vectors[chunk]
            products = (q.astype(precision) @ screen.T).astype(precision, copy=False)
            for metric in task.metrics:
                low, slack = _screen(metric, products, norm2, q_norm2[chunk], dim, precision)
                target = best[at, metric]
                picked_q, picked_x = _candidates(low, slack, target.bound, task)
                if len(picked_q):
                    cost = _exact_cost(metric, q, there, q_norm2[chunk], norm2, picked_q, picked_x, task.digits)
                    target.offer(picked_q, cost, docs[passing][picked_x], [c[passing][picked_x] for c in extra])
    for (at, metric), found in best.items():
        if len(found.query):
            yield _result(queries, chunks[at][1], metric, found)


def _without_surplus_copies(x, docs, x_norm2, batch, facet_column, k):
    """Rows to keep when a batch holds more than ``k`` copies of a vector; None to keep all.

    Copies score alike for every query and ties go to the lower id, so only the ``k`` lowest ids can be
    among the best (of each facet class, when facets are tested). Equal lengths tell cheaply where to look.
    """
    _, length, count = np.unique(x_norm2, return_inverse=True, return_counts=True)
    if not len(x) or count.max() <= k:
        return None
    suspects = np.flatnonzero(count[length] > k)
    rows = np.ascontiguousarray(x[suspects])
    group = np.unique(rows.view(np.dtype((np.void, rows.strides[0]))).ravel(), return_inverse=True)[1]
    if facet_column is not None:
        for column in (facet_column, facet_column + 1):
            code = pc.fill_null(batch.column(column).dictionary_encode().indices, -1).to_numpy()[suspects]
            group = np.unique(np.stack([group, code]), axis=1, return_inverse=True)[1].ravel()
    order = np.lexsort((docs[suspects], group))
    ordered = group[order]
    place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, side="left")
    return np.delete(np.arange(len(x)), suspects[order[place >= k]])


def _screen_precision(x_norm2, q_norm2):
    """Single precision, unless squared lengths leave the range in which its error bound holds."""
    norms = np.concatenate([x_norm2, q_norm2])
    norms = norms[norms > 0]
    in_range = not len(norms) or (norms.min() > 1e-20 and norms.max() < 1e30)
    return np.float32 if in_range else np.float64


def _screen(metric, products, x_norm2, q_norm2, dim, precision):
    """Lower bounds on the cost of every pair, and the width of the uncertainty (per row and per query).

    A pair's exact cost lies between ``low`` and ``low + slack``.
    """
    error = _error(dim, precision)
    if metric == "l2":
        x_part, q_part = x_norm2 * (1 - error), q_norm2 * (1 - error)
        low = x_part.astype(precision)[None, :] + q_part.astype(precision)[:, None] - 2 * products
        return low, (2 * error * x_norm2, 2 * error * q_norm2)
    with np.errstate(divide="ignore", invalid="ignore"):
        x_inverse = (1 / np.sqrt(x_norm2)).astype(precision)
        q_inverse = (1 / np.sqrt(q_norm2)).astype(precision)
        low = -(products * x_inverse[None, :] * q_inverse[:, None]) - precision(error)
    low[:, x_norm2 == 0] = np.inf
    low[q_norm2 == 0, :] = np.inf
    return low, (np.full(len(x_norm2), 2 * error), np.zeros(len(q_norm2)))


def _candidates(low, slack, bound, task):
    """Every pair whose lower bound reaches the k-th best cost known for its query."""
    k = min(task.k, low.shape[1])
    limit = bound
    if k == task.k and not np.isfinite(bound).all():
        nearest = np.argpartition(low, k - 1, axis=1)[:, :k]
        highest = np.take_along_axis(low, nearest, axis=1).astype(np.float64) + slack[0][nearest]
        limit = np.minimum(bound, highest.max(axis=1) + slack[1])
    grain = 0.0 if task.digits is None else 10.0**-task.digits
    limit = np.minimum(limit + grain, np.finfo(low.dtype).max / 2).astype(low.dtype)
    limit = np.nextafter(limit, np.inf, dtype=low.dtype)  # infinite costs stay out
    return np.nonzero(low <= limit[:, None])


def _exact_cost(metric, q, x, q_norm2, x_norm2, picked_q, picked_x, digits):
    """Double-precision cost of the picked pairs, a bounded slice at a time."""
    cost = np.empty(len(picked_q))
    step = max(1, RESCORE_VALUES // max(1, q.shape[1]))
    for start in range(0, len(picked_q), step):
        part = slice(start, start + step)
        a = q[picked_q[part]]
        b = x[picked_x[part]].astype(np.float64)
        if metric == "l2":
            a -= b
            cost[part] = np.einsum("ij,ij->i", a, a)
        else:
            cost[part] = -np.einsum("ij,ij->i", a, b) / (
                np.sqrt(q_norm2[picked_q[part]]) * np.sqrt(x_norm2[picked_x[part]])
            )
    return round_half_away(cost, digits)


UNASKED, UNKNOWN = -2, -1


def _facet_codes(query_facets):
    """A number for each facet that is asked for, and those of the queries; ``UNASKED`` without a facet."""
    codes = {value: code for code, value in enumerate(dict.fromkeys(query_facets)) if value is not None}
    return codes, np.array([codes.get(value, UNASKED) for value in query_facets])


def _row_facets(codes, batch, column):
    """The number of each row's facet (``UNKNOWN`` for one that nobody asks for), and whether it always passes."""
    coded = batch.column(column).dictionary_encode()
    numbers = np.array([codes.get(value, UNKNOWN) for value in coded.dictionary.to_pylist()] + [UNKNOWN])
    rows = numbers[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]
    return rows, batch.column(column + 1).to_numpy(zero_copy_only=False).astype(bool)


def _result(queries, chunk, metric, found):
    at = chunk[found.query]
    cost = found.cost if metric == "l2" else 0.0 - found.cost
    n = len(at)
    columns = {
        "query_id": pa.array(queries.ids[at], pa.int64()),
        "metric": pa.array([metric] * n, pa.string()),
        "doc_id": pa.array(found.doc, pa.int64()),
        "score": pa.array(cost, pa.float64()),
    }
    for name, values in (("q", [c[at] for c in queries.carry]), ("c", found.carry)):
        for i, value in enumerate(values):
            columns[f"{name}{i}"] = pa.array(value, pa.string(), from_pandas=True)
    return pa.RecordBatch.from_pydict(columns)


class Part(NamedTuple):
    """Rows of a corpus as a matrix, in no order."""

    ids: np.ndarray
    vectors: np.ndarray


def corpus_part(table: pa.Table, dim: int, k: int) -> tuple[Part, list[pa.Array]]:
    """A part of a corpus and its carried columns; columns in order: id, vector, carried columns.

    Rows that match nothing are left out, and of copies all beyond the ``k`` lowest ids. The others are mixed, so that a
    search through them soon knows good rows for every query, also when the table is sorted.
    """
    rows, x = matrix_of(table.column(1), dim)
    x_norm2 = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    finite = np.isfinite(x_norm2)
    if not finite.all():
        rows, x, x_norm2 = rows[finite], x[finite], x_norm2[finite]
    docs = table.column(0).to_numpy()[rows]
    kept = _without_surplus_copies(x, docs, x_norm2, None, None, k)
    mixed = np.random.default_rng(0).permutation(len(x) if kept is None else kept)
    carried = table.select(range(2, table.num_columns)).take(pa.array(rows[mixed])).combine_chunks()
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in carried.columns]
    return Part(docs[mixed], x[mixed]), columns


class Lists:
    """The k lowest (cost, id) rows of each query of a chunk under one metric, and pairs that may join them, not scored yet.

    Pairs are scored and sorted in once they are as many as the rows of the lists, so sorting takes few rounds.
    """

    def __init__(self, metric: str, queries: np.ndarray, norm2: np.ndarray, task: Task):
        self.metric, self.queries, self.norm2, self.task = metric, queries, norm2, task
        self.query = np.empty(0, np.int16)
        self.cost = np.empty(0, np.float64)
        self.doc = np.empty(0, np.int64)
        self.place = np.empty(0, np.int64)  # in the whole corpus, for the carried columns
        self.bound = np.full(len(queries), np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def limits(self, precision) -> np.ndarray:
        """What a query's screened products must reach (see :func:`_scaled`)."""
        error = _error(self.queries.shape[1], precision)
        grain = 0.0 if self.task.digits is None else 10.0**-self.task.digits
        reached = self.bound + grain
        if self.metric == "l2":
            limit = (self.norm2 * (1 - error) - reached) / 2
        else:
            with np.errstate(invalid="ignore"):
                limit = (-reached - error) * np.sqrt(self.norm2)
            limit[self.norm2 == 0] = np.inf
        return np.nextafter(limit.astype(precision), precision(-np.inf))[:, None]

    def first_bounds(self, scaled: np.ndarray, x: np.ndarray, x_norm2: np.ndarray) -> None:
        """The k-th best of some rows can't be better than the k-th best of all."""
        n, k = len(self.queries), self.task.k
        if scaled.shape[1] <= k:
            return
        ranked = np.where(np.isnan(scaled), -np.inf, scaled)
        near = np.argpartition(ranked, scaled.shape[1] - k, axis=1)[:, -k:].ravel()
        cost = self._exact(np.repeat(np.arange(n), k), near, x, x_norm2).reshape(n, k).max(axis=1)
        self.bound = np.where(np.isfinite(cost), cost, np.inf)

    def wait(self, query: np.ndarray, row: np.ndarray) -> bool:
        """Keep pairs for later; whether it is time to score them."""
        self.waiting.append((query, row))
        self.n_waiting += len(query)
        return self.n_waiting >= max(len(self.query), FEWEST_WAITING)

    def settle(self, part: Part, x_norm2: np.ndarray, start: int) -> None:
        """Score the pairs that wait, rows of a part that begins at ``start``, and cut the lists."""
        if not self.n_waiting:
            return
        query, row = (np.concatenate(column) for column in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        cost = self._exact(query, row, part.vectors, x_norm2)
        near = np.flatnonzero((cost <= self.bound[query]) & (cost < np.inf))
        query = np.concatenate([self.query, query[near].astype(np.int16)])
        cost = np.concatenate([self.cost, cost[near]])
        doc = np.concatenate([self.doc, part.ids[row[near]]])
        place = np.concatenate([self.place, start + row[near]])
        order = _by_query_and_cost(query, cost, doc)
        ranked = query[order]
        rank = np.arange(len(ranked)) - np.searchsorted(ranked, np.arange(len(self.queries)))[ranked]
        order, rank = order[rank < self.task.k], rank[rank < self.task.k]
        self.query, self.cost, self.doc, self.place = query[order], cost[order], doc[order], place[order]
        last = rank == self.task.k - 1
        self.bound[self.query[last]] = self.cost[last]

    def _exact(self, query, row, x, x_norm2):
        with np.errstate(divide="ignore", invalid="ignore"):
            return _exact_cost(self.metric, self.queries, x, self.norm2, x_norm2, query, row, self.task.digits)


def _by_query_and_cost(query, cost, doc):
    """The order by query, cost and id."""
    order = np.argsort(cost)
    order = order[np.argsort(query[order], kind="stable")]
    ranked, costs = query[order], cost[order]
    tied = (ranked[1:] == ranked[:-1]) & (costs[1:] == costs[:-1])
    if tied.any():  # runs of equal costs are put in order in their places
        runs = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        among = order[runs]
        order[runs] = among[np.lexsort((doc[among], cost[among], query[among]))]
    return order


def _error(dim, precision):
    """Bound on the relative error of a product of vectors, with some for what is done with it."""
    return (dim + 16) * float(np.finfo(precision).eps) / 2


def search(
    batches: Iterator[pa.RecordBatch], load_parts: list, load_carried: list, task: Task, dim: int, n_query_carry: int, max_queries: int
) -> Iterator[pa.RecordBatch]:
    """The best rows of a whole corpus for every query and metric, one list in a row.

    The queries lie in the batches: id, vector, carried columns. Up to ``max_queries`` of them meet the parts of the corpus one
    after the other, of which one is in memory at a time: ``load_parts`` and ``load_carried`` have a function for each.
    """
    group: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, max_queries):
            cut = batch.slice(start, max_queries)
            if group and sum(b.num_rows for b in group) + cut.num_rows > max_queries:
                yield from _answer(pa.Table.from_batches(group), load_parts, load_carried, task, dim, n_query_carry)
                group = []
            group.append(cut)
    if group:
        yield from _answer(pa.Table.from_batches(group), load_parts, load_carried, task, dim, n_query_carry)


def _answer(table, load_parts, load_carried, task, dim, n_query_carry):
    rows, vectors = matrix_of(table.column(1), dim)
    vectors = vectors.astype(np.float64)
    norm2 = np.einsum("ij,ij->i", vectors, vectors)
    finite = np.isfinite(norm2)
    rows, vectors, norm2 = rows[finite], vectors[finite], norm2[finite]
    chunks = [slice(at, at + QUERY_ROWS) for at in range(0, len(rows), QUERY_ROWS)]
    lists = [[Lists(metric, vectors[chunk], norm2[chunk], task) for metric in task.metrics] for chunk in chunks]
    starts = [0]
    for load in load_parts if chunks else []:
        part = Part(*load())
        _meet(part, starts[-1], lists, norm2, dim)
        starts.append(starts[-1] + len(part.ids))
    for chunk, found in zip(chunks, lists):
        queries = table.take(pa.array(rows[chunk]))
        carried = _carried(np.concatenate([f.place for f in found]), starts, load_carried, task.n_corpus_carry)
        done = 0
        for f in found:
            yield _lists(queries, f, [c.slice(done, len(f.place)) for c in carried], n_query_carry)
            done += len(f.place)


def _meet(part: Part, start: int, lists: list[list[Lists]], norm2: np.ndarray, dim: int) -> None:
    """Hold the rows of a part, which begins at ``start``, against all queries."""
    x_norm2 = np.einsum("ij,ij->i", part.vectors, part.vectors, dtype=np.float64)
    precision = _screen_precision(x_norm2, norm2)
    x = part.vectors.astype(precision, copy=False)
    half = (x_norm2 * (1 - _error(dim, precision)) / 2).astype(precision)
    with np.errstate(divide="ignore"):
        inverse = (1 / np.sqrt(x_norm2)).astype(precision)
    for of_chunk in lists:
        q = of_chunk[0].queries.astype(precision)
        limits = [found.limits(precision) for found in of_chunk]
        shape = (len(q), CORPUS_ROWS)
        full = (np.empty(shape, precision), np.empty(shape, precision), np.empty(shape, bool))
        for at in range(0, len(x), CORPUS_ROWS):
            tile = slice(at, at + CORPUS_ROWS)
            n = len(half[tile])
            products, scaled, passing = full if n == CORPUS_ROWS else (np.empty((len(q), n), b.dtype) for b in full)
            np.matmul(q, x[tile].T, out=products)
            for i, found in enumerate(of_chunk):
                _scaled(found.metric, products, half[tile], inverse[tile], scaled)
                if not len(found.query) and not found.n_waiting:
                    found.first_bounds(scaled, part.vectors[tile], x_norm2[tile])
                    limits[i] = found.limits(precision)
                np.greater_equal(scaled, limits[i], out=passing)
                picked = _true_places(passing)
                if len(picked) and found.wait(picked // n, at + picked % n):
                    found.settle(part, x_norm2, start)
                    limits[i] = found.limits(precision)
        for found in of_chunk:
            found.settle(part, x_norm2, start)


def _scaled(metric, products, half, inverse, out):
    """Products from which a query's nearest rows have the highest values.

    For ``l2`` less half the row's squared length (a little less than that): cost = query's squared length - 2 x this. For
    ``cosine`` divided by the row's length; without one that is not a number, which reaches no limit.
    """
    if metric == "l2":
        np.subtract(products, half, out=out)
    else:
        with np.errstate(invalid="ignore"):
            np.multiply(products, inverse, out=out)


def _true_places(mask):
    """As ``flatnonzero``, eight at a time: nearly all are false."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + bit


def _carried(places, starts, load_carried, n_carry):
    """The carried columns of rows at these places of the corpus."""
    if not n_carry:
        return []
    at, taken = [], []
    for start, end, load in zip(starts, starts[1:], load_carried):
        here = np.flatnonzero((places >= start) & (places < end))
        if len(here):
            at.append(here)
            taken.append([column.take(pa.array(places[here] - start)) for column in load()])
    if not at:
        return [pa.array([], pa.string())] * n_carry
    back = np.empty(len(places), np.int64)
    back[np.concatenate(at)] = np.arange(len(places))
    return [pa.concat_arrays(column).take(pa.array(back)) for column in zip(*taken)]


def _lists(queries, found, carried, n_query_carry):
    """Columns: id, metric, the query's carried columns, and the list: id, score, the row's carried columns."""
    ends = np.searchsorted(found.query, np.arange(len(found.queries)), side="right")
    score = found.cost if found.metric == "l2" else 0.0 - found.cost
    columns = [pa.array(found.doc, pa.int64()), pa.array(score, pa.float64()), *(c.cast(pa.string()) for c in carried)]
    names = ["doc_id", "score", *(f"c{i}" for i in range(len(carried)))]
    hits = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays(columns, names))
    row = {"query_id": queries.column(0).combine_chunks(), "metric": pa.array([found.metric] * len(hits), pa.string())}
    for i in range(n_query_carry):
        row[f"q{i}"] = queries.column(2 + i).combine_chunks().cast(pa.string())
    return pa.RecordBatch.from_pydict(row | {"hits": hits})
