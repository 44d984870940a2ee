"""GraphSAGE node and edge classifiers, and the transfer experiment.

Graphs up to MAX_EDGES edges, the size of the slices and subgraphs of the experiments, are trained in NumPy; larger ones on
the cluster (distributed), with the same gradients. Scoring is distributed at every size.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph, checkpointed
from ..operators.vectors import scattered

if TYPE_CHECKING:
    from py4j.java_gateway import JavaObject

    from . import distributed

MAX_EDGES = 2_000_000


@dataclass(frozen=True)
class ModelConfig:
    hidden: int = 128
    emb: int = 128
    layers: int = 2
    dropout: float = 0.1
    node_epochs: int = 20
    edge_epochs: int = 15
    syn_node_epochs: int = 20
    syn_edge_epochs: int = 15
    lr: float = 1e-3
    weight_decay: float = 1e-4
    seed: int = 7
    edges_only: bool = False
    warm_start: bool = False


@dataclass(frozen=True)
class PrivacyConfig:
    """Clipping and noise of private training: a batch's gradient is clipped as a whole to clip and gets noise of the deviation noise * clip.

    steps are those of each epoch; ratio is positives for each negative of a batch; hops reach from a batch's nodes to the subgraph it sees.
    """

    noise: float = 1.0
    clip: float = 1.0
    delta: float = 1e-5
    batch: int = 512
    steps: int = 40
    hops: int = 2
    ratio: int = 1


def fits(graph: PropertyGraph) -> bool:
    """Whether one process trains it."""
    return graph.edges.limit(MAX_EDGES + 1).count() <= MAX_EDGES


@dataclass
class Arrays:
    """A graph as arrays: nodes renumbered from 0."""

    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray
    split: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    attr: np.ndarray
    y_edge: np.ndarray
    edge_split: np.ndarray

    @classmethod
    def of(cls, graph: PropertyGraph, node_columns: list[str], edge_columns: list[str]) -> Arrays:
        if not fits(graph):
            raise ValueError(f"arrays hold at most {MAX_EDGES} edges; distributed.LaidOut has no bound")
        nodes = graph.nodes.select("node", "y", "split", *node_columns).orderBy("node").toPandas()
        edges = graph.edges.select("eid", "src", "dst", "y", "split", *edge_columns).orderBy("eid").toPandas()
        ids = nodes["node"].to_numpy()
        at = {v: k for k, v in enumerate(ids.tolist())}
        where = lambda c: np.array([at[v] for v in edges[c].tolist()], np.int64)
        number = lambda df, c: df[c].to_numpy(np.float64).reshape(len(df), -1) if c else np.zeros((len(df), 0))
        return cls(ids, np.nan_to_num(number(nodes, node_columns)), nodes["y"].to_numpy(), nodes["split"].to_numpy(), where("src"), where("dst"), np.nan_to_num(number(edges, edge_columns)), edges["y"].to_numpy(), edges["split"].to_numpy())


    def around(self, seeds: np.ndarray, hops: int) -> tuple[Arrays, np.ndarray]:
        """The subgraph of all nodes from which a seed is reached in at most so many edges, and each node's place in it (-1: outside)."""
        kept = np.zeros(len(self.ids), bool)
        kept[seeds] = True
        front = kept.copy()
        for _ in range(hops):
            back = self.src[front[self.dst]]
            front = np.zeros(len(self.ids), bool)
            front[back] = True
            kept |= front
        place = np.where(kept, np.cumsum(kept) - 1, -1)
        own = kept[self.src] & kept[self.dst]
        return Arrays(self.ids[kept], self.x[kept], self.y[kept], self.split[kept], place[self.src[own]], place[self.dst[own]], self.attr[own], self.y_edge[own], self.edge_split[own]), place

    def columns_of(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """For pairs of nodes the last edge between them, -1 where there is none."""
        name = self.src * len(self.ids) + self.dst
        keys, last = np.unique(name[::-1], return_index=True)
        asked = src * len(self.ids) + dst
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        return np.where(keys[at] == asked, len(name) - 1 - last[at], -1) if len(keys) else np.full(len(src), -1)


class Model:
    """A SAGE encoder with a linear node head and a two-layer edge head; gradients by hand."""

    def __init__(self, node_width: int, edge_width: int, config: ModelConfig) -> None:
        if config.layers < 2:
            raise ValueError("the encoder has two layers at least")
        rng = np.random.default_rng(config.seed)
        self.config, self.rng, self.widths = config, rng, (node_width, edge_width)
        sizes = [node_width] + [config.hidden] * (config.layers - 1) + [config.emb]
        init = lambda a, b: rng.uniform(-1, 1, (a, b)) / math.sqrt(max(a, 1))
        self.w: dict[str, np.ndarray] = {}
        for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            self.w |= {f"mean{k}": init(a, b), f"bias{k}": np.zeros(b), f"self{k}": init(a, b)}
        self.w |= {"node": init(config.emb, 1), "node_bias": np.zeros(1)}
        self.w |= {"edge1": init(2 * config.emb + edge_width, config.hidden), "edge1_bias": np.zeros(config.hidden), "edge2": init(config.hidden, config.hidden), "edge2_bias": np.zeros(config.hidden), "edge3": init(config.hidden, 1), "edge3_bias": np.zeros(1)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.step = 0

    def encode(self, g: Arrays, train: bool) -> tuple[np.ndarray, list]:
        many = np.maximum(np.bincount(g.dst, minlength=len(g.ids)), 1)[:, None]
        h, kept = g.x, []
        for k in range(self.config.layers):
            mean = scattered(h[g.src], g.dst, len(g.ids)) / many
            z = mean @ self.w[f"mean{k}"] + self.w[f"bias{k}"] + h @ self.w[f"self{k}"]
            mask = np.ones_like(z)
            if k < self.config.layers - 1:
                mask = (z > 0).astype(float)
                if train and self.config.dropout:
                    mask *= (self.rng.random(z.shape) >= self.config.dropout) / (1 - self.config.dropout)
            kept.append((h, mean, mask))
            h = z * mask
        return h, kept

    def backward(self, g: Arrays, kept: list, dh: np.ndarray) -> dict[str, np.ndarray]:
        many, out = np.maximum(np.bincount(g.dst, minlength=len(g.ids)), 1)[:, None], {}
        for k in reversed(range(self.config.layers)):
            h, mean, mask = kept[k]
            dz = dh * mask
            out |= {f"mean{k}": mean.T @ dz, f"bias{k}": dz.sum(0), f"self{k}": h.T @ dz}
            dh = dz @ self.w[f"self{k}"].T + scattered((dz @ self.w[f"mean{k}"].T / many)[g.dst], g.src, len(g.ids))
        return out

    def node_logits(self, h: np.ndarray) -> np.ndarray:
        return (h @ self.w["node"] + self.w["node_bias"]).ravel()

    def edge_forward(self, g: Arrays, h: np.ndarray, rows: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        x, out = np.concatenate([h[g.src[rows]], h[g.dst[rows]], g.attr[rows]], 1), []
        for k in (1, 2):
            z = (out[-1][0] if out else x) @ self.w[f"edge{k}"] + self.w[f"edge{k}_bias"]
            mask = (z > 0).astype(float)
            if train and self.config.dropout:
                mask *= (self.rng.random(z.shape) >= self.config.dropout) / (1 - self.config.dropout)
            out.append((z * mask, mask))
        return (out[1][0] @ self.w["edge3"] + self.w["edge3_bias"]).ravel(), [x, *out]

    def node_gradient(self, g: Arrays, rows: np.ndarray, weight: float) -> dict[str, np.ndarray]:
        h, kept = self.encode(g, True)
        d = np.zeros(len(g.ids))
        d[rows] = loss_gradient(self.node_logits(h)[rows], g.y[rows], weight)
        return {"node": h.T @ d[:, None], "node_bias": np.array([d.sum()])} | self.backward(g, kept, d[:, None] @ self.w["node"].T)

    def edge_gradient(self, g: Arrays, rows: np.ndarray, weight: float, y: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """y: labels of the rows, unless they are the graph's."""
        h, kept = self.encode(g, True)
        logits, (x, (a, mask_a), (b, mask_b)) = self.edge_forward(g, h, rows, True)
        d = loss_gradient(logits, g.y_edge[rows] if y is None else y, weight)[:, None]
        db = d @ self.w["edge3"].T * mask_b
        da = db @ self.w["edge2"].T * mask_a
        dx, size = da @ self.w["edge1"].T, h.shape[1]
        out = {"edge3": b.T @ d, "edge3_bias": d.sum(0), "edge2": a.T @ db, "edge2_bias": db.sum(0), "edge1": x.T @ da, "edge1_bias": da.sum(0)}
        dh = scattered(dx[:, :size], g.src[rows], len(g.ids)) + scattered(dx[:, size : 2 * size], g.dst[rows], len(g.ids))
        return out | self.backward(g, kept, dh)

    def adam(self, gradient: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, d in gradient.items():
            d = d + self.config.weight_decay * self.w[name]
            m, v = self.moments[name]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            self.w[name] = self.w[name] - self.config.lr * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)

    def copy(self) -> dict[str, np.ndarray]:
        return {k: v.copy() for k, v in self.w.items()}


def loss_gradient(logits: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    """Of the mean weighted cross-entropy, by logits."""
    p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
    return (p * (1 + (weight - 1) * y) - weight * y) / max(len(y), 1)


def weight_of(y: np.ndarray, most: float = 50_000.0) -> float:
    p = int(y.sum())
    return min((len(y) - p) / p, most) if p else 1.0


def precision(y: np.ndarray, score: np.ndarray) -> float:
    """Average precision, ties one threshold; not a number with one class."""
    if not 0 < y.sum() < len(y):
        return math.nan
    values, at = np.unique(-score, return_inverse=True)
    tp, all_ = np.cumsum(np.bincount(at, y, len(values))), np.cumsum(np.bincount(at, minlength=len(values)))
    return float((np.diff(tp, prepend=0) / y.sum() * tp / all_).sum())


def parts(g: Arrays, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the rows of training and of validation."""
    y, split = (g.y, g.split) if target == "node" else (g.y_edge, g.edge_split)
    return y, np.flatnonzero(split == "train"), np.flatnonzero(split == "val")


class Best:
    """The weights of the best average precision on the validation rows; the last ones if there is none. Written besides, if a folder is given."""

    def __init__(self, model: Model, g: Arrays, target: str, store: Store | None = None) -> None:
        self.model, self.g, self.target, self.store = model, g, target, store
        self.y, _, self.val = parts(g, target)
        self.score, self.kept = -math.inf, None

    def after(self, epoch: int) -> None:
        self.keep(self.judged(self.model), epoch)

    def keep(self, found: float, epoch: int) -> None:
        if found > self.score:
            self.score, self.kept = found, self.model.copy()
            if self.store:
                self.store.put("best", self.model)
        if self.store:
            self.store.put(f"epoch_{epoch:04d}", self.model)

    def resumed(self) -> int:
        """Epochs that an interrupted run has done; its best weights are judged again."""
        done = self.store.resumed(self.model) if self.store else 0
        if done and "best.npz" in self.store.names(self.store.running):
            best = self.store.load("best", Model(*self.model.widths, self.model.config), running=True)
            self.score, self.kept = self.judged(best), best.w
        return done

    def judged(self, model: Model) -> float:
        return precision(self.y[self.val], logits(model, self.g, self.target)[self.val])

    def restore(self) -> Model:
        self.model.w = self.kept or self.model.w
        if self.store:
            self.store.finish()
        return self.model


@dataclass(frozen=True)
class Store:
    """Weights by tag and name in a folder that Spark's file systems reach, so that they outlive the driver.

    A run writes into a folder of its own, folder/tag.next, each file whole or not at all, and takes the place of the run
    before it only when it is complete; a run that was interrupted is found there and goes on after its last epoch.
    """

    spark: SparkSession
    folder: str
    tag: str

    @property
    def running(self) -> str:
        return f"{self.folder}/{self.tag}.next"

    def at(self, path: str) -> tuple[JavaObject, JavaObject]:
        """A path of Hadoop's and its file system."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, path: str, data: bytes) -> None:
        """The file appears under its name once it is whole."""
        part, files = self.at(f"{path}.{uuid.uuid4().hex}.part")
        out = files.create(part)
        out.write(bytearray(data))
        out.close()
        end, _ = self.at(path)
        files.delete(end, False)
        if not files.rename(part, end):
            raise OSError(f"{path} could not be written")

    def read(self, path: str) -> bytes:
        at, files = self.at(path)
        if not files.exists(at):
            raise FileNotFoundError(path)
        stream = files.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        at, files = self.at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().endswith(".npz")) if files.exists(at) else []

    def put(self, name: str, model: Model) -> None:
        """Weights, and what a run needs to go on: the optimiser's moments and step."""
        held = {f"w/{k}": v for k, v in model.w.items()} | {f"m/{k}": m for k, (m, _) in model.moments.items()} | {f"v/{k}": v for k, (_, v) in model.moments.items()}
        packed = io.BytesIO()
        np.savez(packed, step=np.array(model.step), **held)
        self.write(f"{self.running}/{name}.npz", packed.getvalue())

    def load(self, name: str, model: Model, *, running: bool = False) -> Model:
        """Of the last complete run, or of the one under way."""
        with np.load(io.BytesIO(self.read(f"{self.running if running else f'{self.folder}/{self.tag}'}/{name}.npz"))) as held:
            if {k: v.shape for k, v in model.w.items()} != {k[2:]: held[k].shape for k in held.files if k.startswith("w/")}:
                raise ValueError("the stored weights are of another model")
            model.w = {k: held[f"w/{k}"] for k in model.w}
            model.moments = {k: (held[f"m/{k}"].copy(), held[f"v/{k}"].copy()) for k in model.w}
            model.step = int(held["step"])
        return model

    def resumed(self, model: Model) -> int:
        """The last epoch of an interrupted run of this model, whose state the model then has; 0 if there is none."""
        epochs = [n for n in self.names(self.running) if n.startswith("epoch_")]
        if not epochs:
            return 0
        self.load(epochs[-1].removesuffix(".npz"), model, running=True)
        return int(epochs[-1].removeprefix("epoch_").removesuffix(".npz"))

    def finish(self) -> None:
        """The run's folder takes the place of the one before it as a whole."""
        (old, files), (new, _), (gone, _) = self.at(f"{self.folder}/{self.tag}"), self.at(self.running), self.at(f"{self.folder}/{self.tag}.{uuid.uuid4().hex}.old")
        if not files.exists(new):
            return
        if files.exists(old) and not files.rename(old, gone):
            raise OSError(f"{old} could not be replaced")
        if not files.rename(new, old):
            raise OSError(f"{new} could not be put in place")
        files.delete(gone, True)


def trained(model: Model, g: Arrays, target: str, epochs: int) -> Model:
    """Full-batch epochs."""
    y, rows, _ = parts(g, target)
    weight, best = weight_of(y[rows]), Best(model, g, target)
    for epoch in range(1, epochs + 1 if len(rows) else 1):
        model.adam((model.node_gradient if target == "node" else model.edge_gradient)(g, rows, weight))
        best.after(epoch)
    return best.restore()


def logits(model: Model, g: Arrays, target: str) -> np.ndarray:
    h, _ = model.encode(g, False)
    return model.node_logits(h) if target == "node" else model.edge_forward(g, h, np.arange(len(g.src)))[0]


def noised(gradient: dict[str, np.ndarray], config: PrivacyConfig, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The gradient scaled to a norm of at most clip, with Gaussian noise of the deviation noise * clip in every component."""
    norm = math.sqrt(sum(float((d * d).sum()) for d in gradient.values()))
    scale = min(1.0, config.clip / (norm + 1e-6))
    return {k: d * scale + rng.normal(0.0, config.noise * config.clip, d.shape) for k, d in gradient.items()}


def trained_privately(model: Model, g: Arrays, target: str, epochs: int, config: PrivacyConfig, store: Store | None = None) -> tuple[Model, dict]:
    """Steps on the surroundings of balanced batches, clipped and noised. Returns the accounting too.

    An edge of a batch is looked up in the batch's subgraph by its ends, so of parallel edges the last one's attributes are
    seen. The accounting is the usual one of subsampled batches, a heuristic without a formal guarantee for graphs.
    """
    from ..operators.splits import batch_quota

    y, rows, _ = parts(g, target)
    pools, weight, best, steps = (rows[y[rows] == 1], rows[y[rows] == 0]), weight_of(y[rows]), Best(model, g, target, store), 0
    done = best.resumed()
    steps = done * config.steps
    for epoch in range(done + 1, epochs + 1 if len(rows) else 1):
        rng = np.random.default_rng([model.config.seed + (target == "edge"), epoch])  # an epoch's draws don't hang on those before it
        for _ in range(config.steps):
            p, n = batch_quota(config.batch, config.ratio, len(pools[0]), len(pools[1]))
            batch = rng.permutation(np.concatenate([rng.choice(pools[0], p, False), rng.choice(pools[1], n, False)]))
            if target == "node":
                near, place = g.around(batch, config.hops)
                gradient = model.node_gradient(near, place[batch], weight)
            else:
                near, place = g.around(np.unique(np.concatenate([g.src[batch], g.dst[batch]])), config.hops)
                gradient = model.edge_gradient(near, near.columns_of(place[g.src[batch]], place[g.dst[batch]]), weight, y[batch])
            model.adam(noised(gradient, config, rng))
            steps += 1
        best.after(epoch)
    return best.restore(), accounted(config, target, epochs, steps, len(rows), store)


def accounted(config: PrivacyConfig, target: str, epochs: int, steps: int, rows: int, store: Store | None) -> dict:
    """The accounting of so many steps over so many training rows."""
    rate = min(1.0, config.batch / max(1, rows))
    return {
        "dp_sgd": True, "target": target, "checkpoints_written": store.folder if store else None, "subgraph_k_hop": config.hops, "noise_multiplier": config.noise, "max_grad_norm": config.clip, "delta": config.delta,
        "batch_size": config.batch, "steps_per_epoch": config.steps, "epochs": epochs, "total_optimizer_steps": steps, "sample_rate_approx": rate, "epsilon_rdp": epsilon(config, rate, steps), "pos_to_neg_ratio": config.ratio,
    }


def epsilon(config: PrivacyConfig, rate: float, steps: int) -> float | None:
    """Renyi accounting of so many steps of the subsampled Gaussian mechanism at whole orders, converted at delta; None without noise or steps."""
    if config.noise <= 0 or not steps:
        return None
    best = math.inf
    for order in range(2, 65):
        if rate >= 1:
            one = order / (2 * config.noise**2)
        else:
            terms = [math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + (k * math.log(rate) if k else 0.0) + (order - k) * math.log1p(-rate) + k * (k - 1) / (2 * config.noise**2) for k in range(order + 1) if rate > 0 or k == 0]
            top = max(terms)
            one = (top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)
        best = min(best, steps * one + math.log(1 / config.delta) / (order - 1))
    return best


def epsilons(pools: DataFrame, config: PrivacyConfig, steps: int) -> DataFrame:
    """pools (rows, ...) with rate, the share of its rows that a batch takes, and epsilon of so many steps on each; NULL without noise, steps or rows."""
    rated = pools.withColumn("rate", F.when(F.col("rows") > 0, F.least(F.lit(1.0), F.lit(float(config.batch)) / F.col("rows"))))
    if config.noise <= 0 or not steps:
        return rated.withColumn("epsilon", F.lit(None).cast("double"))
    two = f"{2 * config.noise**2!r}D"
    choose = "if(k = 0, 0D, aggregate(sequence(1, k), 0D, (s, i) -> s + ln((a - k + i) / i)))"
    terms = f"transform(sequence(0, a), k -> {choose} + k * ln(rate) + (a - k) * log1p(-rate) + k * (k - 1) / {two})"
    top = "greatest(x.top, t)"
    summed = f"aggregate({terms}, named_struct('top', -1e300D, 'sum', 0D), (x, t) -> named_struct('top', {top}, 'sum', x.sum * exp(x.top - {top}) + exp(t - {top})), x -> x.top + ln(x.sum))"
    one = f"if(rate >= 1, a / {two}, {summed} / (a - 1))"
    return rated.withColumn("epsilon", F.expr(f"array_min(transform(sequence(2, 64), a -> {steps} * {one} + {math.log(1 / config.delta)!r}D / (a - 1)))"))


SKIPPED = "Only edges were asked for: the encoder was fitted together with the edge head, and no classifier of accounts exists to be judged."
COMPOSITION = "Each training phase restarts the accounting; the epsilons reported are not composed into one guarantee across phases."


@dataclass
class Transfer:
    """Models fitted on the real and on a synthetic graph, both scored on the real one."""

    config: ModelConfig = field(default_factory=ModelConfig)
    node_columns: list[str] = field(default_factory=list)
    edge_columns: list[str] = field(default_factory=list)
    privacy: PrivacyConfig | None = None
    folder: str | None = None
    accounting: dict = field(default_factory=dict)

    def prepared(self, graph: PropertyGraph) -> Arrays | distributed.LaidOut:
        from . import distributed

        return (Arrays if fits(graph) else distributed.LaidOut).of(graph, self.node_columns, self.edge_columns)

    def fit(self, g: Arrays | distributed.LaidOut, target: str, model: Model, name: str) -> Model:
        from . import distributed

        c, by = self.config, globals() if isinstance(g, Arrays) else vars(distributed)
        epochs = {"node_real": c.node_epochs, "edge_real": c.edge_epochs, "node_syn": c.syn_node_epochs, "edge_syn": c.syn_edge_epochs}[f"{target}_{name}"]
        if self.privacy:
            model, self.accounting[f"{target}_{name}"] = by["trained_privately"](model, g, target, epochs, self.privacy, Store(SparkSession.active(), self.folder, f"{target}_{name}") if self.folder else None)
            return model
        return by["trained"](model, g, target, epochs)

    def metrics(self, graph: PropertyGraph, target: str, model: Model) -> dict:
        from .distributed import edge_scores, node_scores
        from .report import evaluated

        scores = node_scores(graph, model, self.node_columns) if target == "node" else edge_scores(graph, model, self.node_columns, self.edge_columns)
        return evaluated(checkpointed(scores.select("y", "split", "logit")))

    def run(self, real: PropertyGraph, synthetic: Callable[[], PropertyGraph], *, least_nodes: int = 0) -> dict:
        """The report: metrics of real-trained models on all splits, of synthetic-trained ones on the real test split, the drops, how alike the graphs are, the accounting. The synthetic graph is made after the real training."""
        from .report import comparison, sanitised

        widths = len(self.node_columns), len(self.edge_columns)
        g, model = self.prepared(real), Model(*widths, self.config)
        targets, out = ["edge"] if self.config.edges_only else ["node", "edge"], {}
        for t in targets:
            model = self.fit(g, t, model, "real")
            out[t] = {"real_train_eval": self.metrics(real, t, model)}
        other = synthetic()
        if other.nodes.limit(least_nodes).count() < least_nodes:
            raise ValueError(f"the synthetic graph has fewer than {least_nodes} nodes")
        h, second = self.prepared(other), Model(*widths, self.config)
        if self.config.warm_start:
            second.w = model.copy()
        for t in targets:
            second = self.fit(h, t, second, "syn")
            if t == "edge":
                out[t]["synthetic_train_eval"] = self.metrics(other, t, second)
            moved = self.metrics(real, t, second)["test"]
            held = out[t]["real_train_eval"]["test"]
            out[t] |= {"transfer_eval_on_real_test": moved, "drop_test": {f"{k}_drop": held[k] - moved[k] if held[k] is not None and moved[k] is not None else None for k in ("roc_auc", "pr_auc", "f1")}}
        if self.config.edges_only:
            out["node"] = {"skipped": True, "reason": SKIPPED}
        out |= {"training": asdict(self.config), "synthetic_meta": other.meta, "dp_accounting": self.accounting, "checkpoint_dir": self.folder, "edge_checkpoint_dir": self.folder}
        alike = comparison((real.nodes, real.edges), (other.nodes, other.edges), node_columns=self.node_columns, edge_columns=self.edge_columns)
        out |= {"fraud_patterns": alike.pop("fraud_patterns", {}), "similarity": alike}
        if self.privacy:
            out["dp_composition_note"] = COMPOSITION
        return sanitised(out)
