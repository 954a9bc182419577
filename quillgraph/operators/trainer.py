"""Training of link-prediction models: NumPy steps, averaged over Spark's partitions.

Each round sends the parameters and Adam's moments out, every partition makes
steps over its own triples, in a random order of its own, and both come back
averaged. On a large graph steps that hardly ever meet in an entity are made
together (``together``). With one partition this is plain minibatch training, number by number
(``train_locally``). The averages are taken block by block in tasks and written;
the driver reads one copy, n entities x dim numbers and as many again twice for
the moments, in single precision.

With more than ``WHOLE`` parameters no task and no driver holds them all
(``_fit_apart``). Entities are dealt to q x q buckets, the points of a plane; a
task holds the q buckets of a line and makes the steps of the links between
them. The lines of one direction don't meet, so their tasks run at once, and the
q + 1 directions join each two buckets once: an epoch goes over every link once.
Drawn entities come from the task's line.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters that ``train`` may return as arrays.
MOST_PARAMETERS = 50_000_000
#: Parameters up to which each task holds them all; bytes of parameters and moments that it holds otherwise.
WHOLE, HELD = 8_000_000, 512 << 20
#: Rows of a parameter that are averaged together.
BLOCK = 4096
STATE = "name string, block int, n long, data binary"


@dataclass(frozen=True)
class Config:
    """Hyper-parameters; ``loss``: nssa (self-adversarial) or softplus."""

    model: str
    dim: int = 256
    epochs: int = 300
    batch: int = 512
    rate: float = 1e-3
    negatives: int = 256
    loss: str = "softplus"
    margin: float = 0.0
    temperature: float = 1.0
    norm: int = 1
    seed: int = 42


#: The four configurations that are compared.
CONFIGS = {
    "TransE": Config("TransE", loss="nssa", margin=9.0),
    "DistMult": Config("DistMult"),
    "ComplEx": Config("ComplEx"),
    "RotatE": Config("RotatE", epochs=70, loss="nssa", margin=6.0),
}


def width(config: Config) -> int:
    return config.dim * (2 if config.model in ("ComplEx", "RotatE") else 1)


def start(config: Config, entities: int, relations: int) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(config.seed), width(config)
    bound = 6 / np.sqrt(n)
    e = rng.uniform(-bound, bound, (entities, n))
    return {"e": e, "r": _start_relations(config, rng, relations)}


def _start_relations(config: Config, rng: np.random.Generator, relations: int) -> np.ndarray:
    n = width(config)
    bound = 6 / np.sqrt(n)
    r = rng.uniform(-bound, bound, (relations, n))
    if config.model == "RotatE":
        phase = rng.uniform(-np.pi, np.pi, (relations, config.dim))
        r = np.concatenate([np.cos(phase), np.sin(phase)], axis=1)
    return r


def _complex(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1] // 2
    return x[..., :n] + 1j * x[..., n:]


def _real(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z.real, z.imag], axis=-1)


def score_and_gradients(config: Config, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores over the last axis, and their gradients by h, r and t."""
    if config.model == "TransE":
        d = h + r - t
        if config.norm == 1:
            g = -np.sign(d)
            return -np.abs(d).sum(-1), g, g, -g
        size = np.sqrt((d * d).sum(-1, keepdims=True)) + 1e-12
        return -size[..., 0], -d / size, -d / size, d / size
    if config.model == "DistMult":
        return (h * r * t).sum(-1), r * t, h * t, h * r
    hc, rc, tc = _complex(h), _complex(r), _complex(t)
    if config.model == "ComplEx":
        return (hc * rc * tc.conj()).real.sum(-1), _real(rc.conj() * tc), _real(hc.conj() * tc), _real(hc * rc)
    d = hc * rc - tc
    size = np.sqrt((np.abs(d) ** 2).sum(-1, keepdims=True)) + 1e-12
    g = -d / size
    return -size[..., 0], _real(g * rc.conj()), _real(g * hc.conj()), _real(-g)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))  # 0 where the power overflows


def weights(config: Config, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss's derivative by positive (..., batch) and negative (..., batch, k) scores."""
    n, k = negative.shape[-2:]
    if config.loss == "nssa":
        weight = np.exp(config.temperature * (negative - negative.max(-1, keepdims=True)))
        weight /= weight.sum(-1, keepdims=True)  # held constant, as published
        return _sigmoid(-config.margin - positive) / (-2 * n), weight * _sigmoid(config.margin + negative) / (2 * n)
    return _sigmoid(-positive) / -n, _sigmoid(negative) / (n * k)


def loss_of(config: Config, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The mean loss over the last axis of positive (..., batch) and the last two of negative (..., batch, k) scores."""
    if config.loss == "nssa":
        weight = np.exp(config.temperature * (negative - negative.max(-1, keepdims=True)))
        weight /= weight.sum(-1, keepdims=True)
        a, b = _sigmoid(config.margin + positive), _sigmoid(-config.margin - negative)
        return -(np.log(a + 1e-30) + (weight * np.log(b + 1e-30)).sum(-1)).mean(-1) / 2
    return np.logaddexp(0, -positive).mean(-1) + np.logaddexp(0, negative).mean((-2, -1))


def loss_and_weights(config: Config, positive: np.ndarray, negative: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    return float(loss_of(config, positive, negative)), *weights(config, positive, negative)


#: Steps are made together while so many entities are there for each that they touch; and at most so many.
APART, TOGETHER = 32, 128


def together(config: Config, entities: int) -> int:
    """How many steps may be made at once: 1 on a small graph, more where steps hardly ever meet in an entity."""
    return max(1, min(TOGETHER, entities // (APART * config.batch * (2 + config.negatives))))


def packed(params: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each entity and, after them, each relation: its vector, Adam's two moments and the number of its steps. Kept in single precision, reckoned in double."""
    x = np.concatenate([params["e"], params["r"]])
    out = np.zeros((len(x), 3 * x.shape[1] + 1), np.float32)
    out[:, : x.shape[1]] = x
    return out


def _adam(rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    n = g.shape[1]
    rows[:, 3 * n] += 1
    k = rows[:, 3 * n :].astype(np.float64)
    fewer = np.sqrt(1 - np.exp(k * np.log(0.999)))
    m, v = rows[:, n : 2 * n] * 0.9, rows[:, 2 * n : 3 * n] * 0.999  # contiguous copies
    m += 0.1 * g
    v += 0.001 * (g * g)
    rows[:, n : 2 * n], rows[:, 2 * n : 3 * n] = m, v
    np.sqrt(v, out=v)
    v += (1e-8 * fewer).astype(g.dtype)
    m /= v
    m *= (rate * fewer / (1 - np.exp(k * np.log(0.9)))).astype(g.dtype)
    rows[:, :n] -= m


def epoch(config: Config, state: np.ndarray, entities: int, triples: np.ndarray, head: np.ndarray, rng: np.random.Generator, group: int | None = None) -> float:
    """One pass over ``triples`` that changes ``state``; ``head``: each relation's probability that the head is corrupted. Returns the mean loss.

    On a large graph ``group`` batches are scored together (``together``). They
    hardly ever meet in an entity; a row that several of them touch, a relation's
    above all, takes one step by the mean of their gradients.
    """
    size, group = config.batch, group or together(config, entities)
    order = rng.permutation(len(triples))
    whole = len(order) // size * size
    ends = [*range(0, whole, group * size), whole, *([len(order)] if whole < len(order) else [])]
    losses, count = 0.0, 0
    with np.errstate(over="ignore"):
        for begin, end in zip(ends, ends[1:]):
            b = min(size, end - begin)
            steps = (end - begin) // b
            s, p, o = triples[order[begin:end]].T
            shape = (end - begin, config.negatives)
            other, at_head = rng.integers(0, entities, shape), rng.random(shape) < head[p][:, None]
            # slots: heads, tails, relations, then the drawn entities; slot k is of batch k % len(p) // b
            slots = np.concatenate([s, o, entities + p, other.T.ravel()])
            bits = len(slots).bit_length()
            met = np.sort(slots << bits | np.arange(len(slots)))  # by row, then by slot
            along, met = met & (1 << bits) - 1, met >> bits
            first = np.ones(len(met), bool)
            first[1:] = met[1:] != met[:-1]
            mine = met[first]
            now = state.take(mine, 0)
            if steps == 1:
                now = now.astype(np.float64)
            losses += _step(config, now, along, first, at_head, b, steps)
            count += steps
            if config.model == "RotatE":
                links, n = mine >= entities, width(config)
                z = _complex(now[links, :n])
                now[links, :n] = _real(z / np.maximum(np.abs(z), 1e-12))
            state[mine] = now
    return losses / count if count else 0.0


def _step(config: Config, now: np.ndarray, along: np.ndarray, first: np.ndarray, at_head: np.ndarray, b: int, steps: int) -> float:
    """Moves the rows ``now`` by batches of ``b``; ``along``: the slots in the order of their rows, ``first`` where a row begins. Returns the sum of their losses."""
    n, many, k = width(config), b * steps, config.negatives
    place = np.empty_like(along)
    place[along] = first.cumsum() - 1
    x = now[:, :n].take(place, 0)
    made = _translation if config.model == "TransE" and config.norm == 1 else _general
    g, positive, negative = made(config, x, at_head, b, steps)
    at = np.flatnonzero(first)
    sums, size = g.take(along[at], 0), np.diff(at, append=len(along))
    again = size > 1
    if again.any():  # the rows of several slots
        own, size = along[np.repeat(again, size)], size[again]
        total = np.add.reduceat(g.take(own, 0), np.concatenate([[0], size[:-1].cumsum()]), axis=0)
        if steps > 1:  # the batches that touch a row
            pairs = np.sort(np.repeat(np.arange(len(size)), size) * steps + own % many // b)
            total /= np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // steps).astype(g.dtype)[:, None]
        sums[again] = total
    _adam(now, sums, config.rate)
    return float(loss_of(config, positive, negative).sum())


def _general(config: Config, x: np.ndarray, at_head: np.ndarray, b: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient by each slot's vector, positive (steps, batch) and negative (steps, batch, k) scores."""
    n, many, k = x.shape[1], b * steps, config.negatives
    s, o, r, other = x[:many, None], x[many : 2 * many, None], x[2 * many : 3 * many, None], x[3 * many :].reshape(k, many, n).swapaxes(0, 1)
    swap = at_head[..., None]
    h, t = np.concatenate([s, np.where(swap, other, s)], 1), np.concatenate([o, np.where(swap, o, other)], 1)
    score, gh, gr, gt = score_and_gradients(config, h, r, t)
    positive, negative = score[:, 0].reshape(steps, b), score[:, 1:].reshape(steps, b, k)
    dp, dn = weights(config, positive, negative)
    w = np.concatenate([dp.reshape(many, 1), dn.reshape(many, k)], 1)
    kept = np.concatenate([np.ones((many, 1), bool), ~at_head], 1)  # where the head is the true one
    moved = np.concatenate([np.ones((many, 1), bool), at_head], 1)
    g = np.empty_like(x)
    np.einsum("bkn,bk->bn", gh, w * kept, out=g[:many])
    np.einsum("bkn,bk->bn", gt, w * moved, out=g[many : 2 * many])
    np.einsum("bkn,bk->bn", gr, w, out=g[2 * many : 3 * many])
    np.multiply(np.where(swap, gh[:, 1:], gt[:, 1:]).swapaxes(0, 1), w[:, 1:].T[..., None], out=g[3 * many :].reshape(k, many, n))
    return g, positive, negative


def _translation(config: Config, x: np.ndarray, at_head: np.ndarray, b: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_general`` for TransE by sums of absolute values: all gradients are signs of the same differences."""
    n, many, k = x.shape[1], b * steps, config.negatives
    s, o, r, other = x[:many], x[many : 2 * many], x[2 * many : 3 * many], x[3 * many :].reshape(k, many, n)
    swap, one = at_head.T[..., None], np.ones(n, x.dtype)
    side = np.where(swap, one[0], -one[0])  # of the drawn entity in its difference
    true, d = s + r, side * other
    d += np.where(swap, r - o, true)
    true -= o
    positive, negative = -(np.abs(true) @ one), -(np.abs(d) @ one)
    positive, negative = positive.reshape(steps, b), negative.T.reshape(steps, b, k)
    dp, dn = weights(config, positive, negative)
    g = np.empty_like(x)
    gh, gt, gr, gd = g[:many], g[many : 2 * many], g[2 * many : 3 * many], g[3 * many :].reshape(k, many, n)
    np.multiply(np.sign(true), -dp.reshape(many, 1), out=true)
    np.multiply(np.sign(d), -dn.reshape(many, k).T[..., None], out=d)
    np.add(true, d.sum(0), out=gr)
    np.multiply(d, side, out=gd)  # as the gradient by the drawn entity is d at the head, -d at the tail,
    np.subtract(gr, (d + gd).sum(0) / 2, out=gh)  # half the sum of both is that of the drawn heads
    np.subtract(gh, gr + true, out=gt)
    return g, positive, negative


def _averaged(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of all partitions, weighed by their triples."""
    n = rows.column("n").to_numpy()
    total = sum(np.frombuffer(d, np.float32).astype(np.float64) * k for d, k in zip(rows.column("data").to_pylist(), n.tolist()))
    return pa.table({"name": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([int(n.sum())]), "data": pa.array([(total / n.sum()).astype(np.float32).tobytes()])})


def _ordered(triples: np.ndarray) -> np.ndarray:
    return triples[np.lexsort(triples.T[::-1])]


def fit(triples: DataFrame, config: Config, entities: int, relations: int, partitions: int = 1) -> tuple[DataFrame, list[float], float]:
    """(the vectors as written blocks for ``parameters``, mean loss of each epoch, seconds) for triples (s, p, o as ids)."""
    if (entities + relations) * width(config) > WHOLE:
        return _fit_apart(triples, config, entities, relations)
    from pyspark import TaskContext

    from quillgraph.operators.embeddings import bernoulli_stats
    from quillgraph.session import discard, written

    began = time.time()

    def parts(state: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        for name, rows in (("e", state[:entities]), ("r", state[entities:])):
            for at in range(0, len(rows), BLOCK):
                yield name, at // BLOCK, rows[at : at + BLOCK]

    state = packed(start(config, entities, relations))
    shape = state.shape
    head = np.full(relations, 0.5)
    dealt = written(triples.select("s", "p", "o").repartition(partitions), "train")
    for x in bernoulli_stats(dealt).collect():  # a row per relation
        head[x.p] = x.head_probability
    spark, losses, blocks = triples.sparkSession, [], None
    for k in range(config.epochs):
        sent = spark.sparkContext.broadcast([x for _, _, x in parts(state)])  # pickled block by block
        del state  # the driver holds one copy at a time

        def run(batches: Iterator[pa.RecordBatch], k: int = k, sent=sent) -> Iterator[pa.RecordBatch]:
            found = [np.stack([b.column(c).to_numpy() for c in range(3)], axis=1) for b in batches if b.num_rows]
            if not found:
                return
            own, rows = np.concatenate(sent.value), _ordered(np.concatenate(found))
            rng = np.random.default_rng([config.seed, k, TaskContext.get().partitionId()])
            loss = epoch(config, own, entities, rows, head, rng)
            for n, block, data in (("loss", 0, np.array([loss], np.float32)), *parts(own)):
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([block], pa.int32()), pa.array([len(rows)]), pa.array([data.tobytes()])], ["name", "block", "n", "data"])

        made = dealt.coalesce(partitions).mapInArrow(run, STATE)
        last, blocks = blocks, written(made.groupBy("name", "block").applyInArrow(_averaged, STATE), "train-state")
        sent.destroy()
        if last is not None:
            discard(last)
        loss, state = None, np.empty(shape, np.float32)
        for r in blocks.select("name", "block", "data").toLocalIterator():  # a task's share at a time
            data = np.frombuffer(r.data, np.float32)
            if r.name == "loss":
                loss = float(data[0])
            else:
                at = r.block * BLOCK + (entities if r.name == "r" else 0)
                part = data.reshape(-1, shape[1])
                state[at : at + len(part)] = part
        if loss is None:
            state = packed(start(config, entities, relations))
            break
        losses.append(loss)
    if blocks is None or not losses:  # no epochs or no triples: the state as it starts
        blocks = spark.createDataFrame([(n, block, 0, x.tobytes()) for n, block, x in parts(state)], STATE)
    return blocks.select("name", (F.col("block") * BLOCK).cast("long").alias("first"), F.lit(1).alias("step"), F.lit(4 * shape[1]).alias("wide"), "data"), losses, time.time() - began


@dataclass(frozen=True)
class Plane:
    """q x q buckets of entities, by the remainder of the id, as the points of a plane; q is a prime.

    Line ``j * q + c`` is that of direction j through (0, c), or x = c of the last
    direction. A task's rows: the buckets of its line, one after the other.
    """

    q: int
    entities: int

    @property
    def buckets(self) -> int:
        return self.q * self.q

    def sizes(self) -> np.ndarray:
        return (self.entities - np.arange(self.buckets) + self.buckets - 1) // self.buckets

    def line(self, j: int, c: int) -> list[int]:
        """The buckets of a line, sorted; bucket x * q + y is the point (x, y)."""
        q = self.q
        return [c * q + y for y in range(q)] if j == q else [x * q + (j * x + c) % q for x in range(q)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The line that joins two buckets; the lines of a bucket by direction; the first row of a bucket in a line."""
        n, sizes = self.buckets, self.sizes()
        joins, through, at = np.zeros((n, n), np.int16 if n < 181 else np.int32), np.zeros((n, self.q + 1), np.int32), np.zeros(((self.q + 1) * self.q, n), np.int64)
        for j in range(self.q + 1):
            for c in range(self.q):
                own, k = np.array(self.line(j, c)), j * self.q + c
                joins[np.ix_(own, own)], through[own, j], at[k, own] = k, k, np.concatenate([[0], sizes[own][:-1].cumsum()])
        return joins, through, at

    def rows(self) -> int:
        """Rows of the largest bucket times q: at least those of any line."""
        return self.q * -(-self.entities // self.buckets)


def plane(config: Config, entities: int, relations: int) -> Plane:
    """Lines as long as a task may hold; a link packs into 63 bits."""
    for q in (x for x in range(5, 1000) if all(x % k for k in range(2, x))):
        found = Plane(q, entities)
        rows = found.rows()
        if rows * (12 * width(config) + 4) <= HELD and relations * rows * rows < 1 << 63:
            return found
    raise ValueError("too many parameters")


#: Links that a task deals out at once; bytes of a stored row of several entities, small enough for the JVM's young space.
DEALT, STORED = 1_000_000, 1 << 16
#: Names of settings while lines are read and written: few large rows at a time, a file for each task.
SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
    "spark.sql.unionOutputPartitioning": "false",
}


def _dealt(plane: Plane, triples: DataFrame) -> DataFrame:
    """line, data: sorted links, packed as numbers of 64 bits by the rows of their line."""
    joins, through, at = plane.tables()
    rows, n, q = plane.rows(), plane.buckets, plane.q

    def blobs(found: list[np.ndarray]) -> pa.RecordBatch:
        s, p, o = (np.concatenate(x) for x in zip(*found))
        bs, bo = s % n, o % n
        line = joins[bs, bo].astype(np.int32)
        same = np.flatnonzero(bs == bo)
        line[same] = through[bs[same], (s[same] // n + o[same] // n) % (q + 1)]
        packed = (p * rows + at[line, bs] + s // n) * rows + at[line, bo] + o // n
        order = np.argsort(line.astype(np.uint16), kind="stable")
        ends = np.bincount(line, minlength=len(at)).cumsum()
        parts = np.split(packed[order], ends[:-1])
        kept = [k for k, x in enumerate(parts) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([np.sort(parts[k]).tobytes() for k in kept], pa.binary())], ["line", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for b in batches:
            if b.num_rows:
                found.append([b.column(c).to_numpy() for c in range(3)])
                count += b.num_rows
            if count >= DEALT:
                yield blobs(found)
                found, count = [], 0
        if count:
            yield blobs(found)

    return triples.select(*(F.col(c).cast("long") for c in "spo")).mapInArrow(run, "line int, data binary")


def _heads(plane: Plane, relations: int, links: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each relation's probability that the head is corrupted (``bernoulli_stats``), and the links of each line."""
    rows, n = plane.rows(), plane.buckets
    lines = [(k, np.array(plane.line(*divmod(k, plane.q)))) for k in range((plane.q + 1) * plane.q)]
    _, _, at = plane.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, line = [], None
        for b in batches:
            for k, data in zip(*(b.column(c).to_pylist() for c in range(2))):
                line = _only(line, k)
                found.append(np.frombuffer(data, np.int64))
        if not found:
            return
        every = np.sort(np.concatenate(found))
        once = every[np.diff(every, prepend=-1) > 0]
        p, s, o = once // (rows * rows), once // rows % rows, once % rows
        out = [("n", -1, line, len(every), b"")] + [("t", -1, int(k), int(c), b"") for k, c in enumerate(np.bincount(p)) if c]
        own = lines[line][1]
        ends = [*at[line, own][1:], rows]
        for side, x in (("s", s), ("o", o)):
            pairs = np.sort(p * rows + x)
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            for k in np.unique(p):
                mine = pairs[np.searchsorted(pairs, k * rows) : np.searchsorted(pairs, (k + 1) * rows)] - k * rows
                cuts = np.searchsorted(mine, [0, *ends])
                out += [(side, int(bucket), int(k), 0, (mine[a:e] - at[line, bucket]).astype(np.int32).tobytes()) for bucket, a, e in zip(own, cuts, cuts[1:]) if e > a]
        for a in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[a : a + 64]), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["what", "bucket", "k", "n", "data"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        met = table.column("data").to_pylist()
        n = len(np.unique(np.frombuffer(b"".join(met), np.int32))) if key[0].as_py() in "so" else sum(table.column("n").to_pylist())
        return pa.table({"what": pa.array([key[0].as_py()]), "k": pa.array([key[2].as_py()], pa.int32()), "n": pa.array([n], pa.int64())})

    made = _side_by_side([links.where(F.col("line") == k).select("line", "data") for k, _ in lines]).mapInArrow(run, "what string, bucket int, k int, n long, data binary")
    counts = {(r.what, r.k): r.n for r in made.groupBy("what", "bucket", "k").applyInArrow(merged, "what string, k int, n long").groupBy("what", "k").agg(F.sum("n").alias("n")).collect()}
    head = np.full(relations, 0.5)
    for (what, k), total in counts.items():
        if what == "t":
            tails, heads = total / counts["s", k], total / counts["o", k]
            head[k] = tails / (tails + heads)
    return head, np.array([counts.get(("n", k), 0) for k, _ in lines])


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """A task for each of ``parts``."""
    out = parts[0].coalesce(1)
    for x in parts[1:]:
        out = out.unionByName(x.coalesce(1))
    return out


def _only(before: int | None, line: int) -> int:
    if before not in (None, line):
        raise RuntimeError("a task got two lines")
    return line


def _short(x: np.ndarray) -> np.ndarray:
    """Single precision rounded to its upper 16 bits."""
    return ((np.ascontiguousarray(x).view(np.uint32) + 0x8000) >> 16).astype(np.uint16)


def _long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << 16).view(np.float32)


def _stored(rows: np.ndarray, n: int, whole: bool) -> bytes:
    """Vectors in single precision; if ``whole``, the moments, of which 16 bits are kept, and the steps after them."""
    parts = [np.ascontiguousarray(rows[:, :n]).view(np.uint8)]
    if whole:
        parts += [_short(rows[:, n : 3 * n]).view(np.uint8), np.ascontiguousarray(rows[:, 3 * n :]).view(np.uint8)]
    return np.concatenate(parts, axis=1).tobytes()


def _restored(data: bytes, n: int, out: np.ndarray) -> None:
    x = np.frombuffer(data, np.uint8).reshape(-1, 8 * n + 4)
    out[:, :n] = np.ascontiguousarray(x[:, : 4 * n]).view(np.float32)
    out[:, n : 3 * n] = _long(np.ascontiguousarray(x[:, 4 * n : 8 * n]).view(np.uint16))
    out[:, 3 * n :] = np.ascontiguousarray(x[:, 8 * n :]).view(np.float32)


def _fit_apart(triples: DataFrame, config: Config, entities: int, relations: int) -> tuple[DataFrame, list[float], float]:
    """``fit`` for parameters that no task can hold: a round for each direction of the plane, a task for each of its lines.

    A round's tasks read their buckets from the files of the last round, and write
    them; what they have made of the relations is averaged by their links.
    """
    from quillgraph.session import discard, written

    began, spark, n = time.time(), triples.sparkSession, width(config)
    if relations * n > MOST_PARAMETERS:
        raise ValueError("more relations than the driver may hold")
    by = plane(config, entities, relations)
    q, sizes, (_, _, at), block = by.q, by.sizes(), by.tables(), max(1, STORED // (8 * n + 4))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    links = written(_dealt(by, triples.coalesce(4 * spark.sparkContext.defaultParallelism)), "train-links", ("line",), compression="zstd")
    _tidy(spark)
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        head, count = _heads(by, relations, links)
        _tidy(spark)
        rng = np.random.default_rng(config.seed)
        rng.bit_generator.advance(entities * n)
        shared = np.zeros((relations, 3 * n + 1), np.float32)
        shared[:, :n] = _start_relations(config, rng, relations)
        rounds = [(k, int(j)) for k in range(config.epochs if count.sum() else 0) for j in np.random.default_rng([config.seed, k]).permutation(q + 1)] or [(0, None)]
        losses, state = [0.0] * (rounds[-1][0] + 1), None
        for place, (k, j) in enumerate(rounds):
            end = place == len(rounds) - 1
            lines = [(j or 0) * q + c for c in range(q)]
            own = {line: by.line(*divmod(line, q)) for line in lines}

            def run(batches: Iterator[pa.RecordBatch], k: int = k, j: int | None = j, own: dict = own, shared: np.ndarray = shared, first: bool = state is None, end: bool = end) -> Iterator[pa.RecordBatch]:
                line, rows, packed = None, None, []
                for b in batches:
                    for of, bucket, start, data in zip(*(b.column(c).to_pylist() for c in range(4))):
                        line = _only(line, of)
                        if rows is None:
                            inside = int(sizes[own[line]].sum())
                            rows = np.zeros((inside + relations, 3 * n + 1), np.float32)
                            rows[inside:] = shared
                        if bucket >= 0:
                            to = at[line, bucket] + start
                            _restored(data, n, rows[to : to + len(data) // (8 * n + 4)])
                        elif data:
                            packed.append(np.frombuffer(data, np.int64))
                if first:
                    _start_line(config, by, own[line], rows)
                pa.default_memory_pool().release_unused()
                found = np.concatenate(packed) if packed and j is not None else np.empty(0, np.int64)
                del packed
                found.sort()
                most = by.rows()
                ids = np.empty((len(found), 3), np.int32)
                for a in range(0, len(found), BLOCK):
                    x = found[a : a + BLOCK]
                    ids[a : a + BLOCK, 0], ids[a : a + BLOCK, 1], ids[a : a + BLOCK, 2] = x // most % most, x // (most * most), x % most
                del found
                loss = epoch(config, rows, inside, ids, head, np.random.default_rng([config.seed, k, line]))
                done = len(ids)
                del ids
                yield _row(-1, done, np.float64(loss).tobytes() + rows[inside:].tobytes())
                for bucket in own[line]:
                    for a in range(0, int(sizes[bucket]), block):
                        to = at[line, bucket] + a
                        yield _row(bucket, a, _stored(rows[to : to + min(block, int(sizes[bucket]) - a)], n, not end))

            parts = []
            for line in lines:
                got = spark.range(1).select(F.lit(-1).alias("bucket"), F.lit(0).alias("start"), F.lit(b"").alias("data"))
                if count[line]:
                    got = got.unionByName(links.where(F.col("line") == line).select(F.lit(-1).alias("bucket"), F.lit(0).alias("start"), "data"))
                if state is not None:
                    got = got.unionByName(state.where(F.col("bucket").isin(own[line])))
                parts.append(got.select(F.lit(line).alias("line"), "bucket", "start", "data"))
            last, state = state, written(_side_by_side(parts).mapInArrow(run, "bucket int, start int, data binary"), "train-state", compression="uncompressed", **{"parquet.block.size": 4 << 20, "parquet.page.size": 1 << 18})
            if last is not None:
                discard(last)
            if j is not None:
                made = [(r.start, np.frombuffer(r.data[:8])[0], np.frombuffer(r.data[8:], np.float32)) for r in state.where("bucket = -1").collect()]
                total = sum(x[0] for x in made)
                if total:
                    shared = (sum(x[2].astype(np.float64) * x[0] for x in made) / total).astype(np.float32).reshape(shared.shape)
                losses[k] += float(sum(x[0] * x[1] for x in made) / count.sum())
        discard(links)
        blocks = state.where("bucket >= 0").select(F.lit("e").alias("name"), (F.col("bucket") + F.col("start").cast("long") * by.buckets).alias("first"), F.lit(by.buckets).alias("step"), F.lit(4 * n if end else 8 * n + 4).alias("wide"), "data")
        return blocks.unionByName(spark.createDataFrame([("r", 0, 1, 4 * shared.shape[1], shared.tobytes())], blocks.schema)), losses if count.sum() and config.epochs else [], time.time() - began
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _row(bucket: int, start: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([start], pa.int32()), pa.array([data], pa.binary())], ["bucket", "start", "data"])


def _start_line(config: Config, by: Plane, own: list[int], rows: np.ndarray) -> None:
    """The vectors that ``start`` draws for the buckets ``own``, a stretch of ids at a time."""
    n, sizes = width(config), by.sizes()
    bound, rng = 6 / np.sqrt(n), np.random.default_rng(config.seed)
    at = np.concatenate([[0], sizes[own].cumsum()])
    for a in range(0, by.entities, by.buckets * 2048):
        x = rng.uniform(-bound, bound, (min(by.buckets * 2048, by.entities - a), n))
        for to, bucket in zip(at, own):
            mine = x[bucket :: by.buckets]
            rows[to + a // by.buckets : to + a // by.buckets + len(mine), :n] = mine


def _tidy(spark: SparkSession) -> None:
    """Shuffle files of what is written go when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parameters(blocks: DataFrame, name: str, config: Config, kind: str = "double") -> DataFrame:
    """id, v: the vectors of ``e`` or ``r`` from written blocks, unpacked where they are.

    Blocks: ids from ``first`` on by ``step``, a row of ``wide`` bytes each, which begins with the vector.
    """
    n = width(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, step, wide, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
                x = np.frombuffer(data, np.float32).reshape(-1, wide // 4)[:, :n].astype(np.float32 if kind == "float" else np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) * step + first), lists], ["id", "v"])

    return blocks.where(blocks["name"] == name).select("first", "step", "wide", "data").mapInArrow(run, f"id long, v array<{kind}>")


def train(triples: DataFrame, config: Config, entities: int, relations: int, partitions: int = 1) -> tuple[dict[str, np.ndarray], list[float], float]:
    """(parameters, mean loss of each epoch, seconds): ``fit``, with the parameters as arrays."""
    if (entities + relations) * width(config) > MOST_PARAMETERS:
        raise ValueError("more parameters than the driver may hold")
    blocks, losses, seconds = fit(triples, config, entities, relations, partitions)
    params = {}
    for name, rows in (("e", entities), ("r", relations)):
        found = sorted(parameters(blocks, name, config).collect())
        params[name] = np.array([r.v for r in found]).reshape(rows, width(config))
    return params, losses, seconds


def train_locally(triples: np.ndarray, config: Config, entities: int, relations: int, head: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """The same without Spark, as one partition."""
    state, rows = packed(start(config, entities, relations)), _ordered(triples)
    head = np.full(relations, 0.5) if head is None else head
    losses = [epoch(config, state, entities, rows, head, np.random.default_rng([config.seed, k, 0])) for k in range(config.epochs)]
    n = width(config)
    return {"e": state[:entities, :n].astype(np.float64), "r": state[entities:, :n].astype(np.float64)}, losses


def tables(spark: SparkSession, params: dict[str, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Embedding tables (id, v) of entities and relations, to be written as a checkpoint."""

    def make(x: np.ndarray) -> DataFrame:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "v": lists}), "id long, v array<double>")

    return make(params["e"]), make(params["r"])


def summary(name: str, metrics: DataFrame, seconds: float, config: Config) -> dict:
    """The row of a comparison: realistic metrics of both sides."""
    m = {r.metric: r.value for r in metrics.where("side = 'both' and policy = 'realistic'").collect()}
    return {"model": name, "MRR": round(m["mrr"], 4), **{f"Hits@{k}": round(m[f"hits_at_{k}"], 4) for k in (1, 3, 10)}, "train_time_s": round(seconds, 1), "epochs": config.epochs, "embedding_dim": config.dim}


def smaller(config: Config, **changes) -> Config:
    return replace(config, **changes)
