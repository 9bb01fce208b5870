"""Design matrices: formulas, regressors, contrasts, and the graph of model nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hrf
from tessera.operators import variables
from tessera.operators.collections import Collection


@dataclass(frozen=True)
class Formula:
    """The response, the terms (each a tuple of factors) and whether there is an intercept."""

    response: str | None
    terms: tuple[tuple[str, ...], ...]
    intercept: bool = True


def parse_formula(text: str) -> Formula:
    """`y ~ a + b:c + d*e - 1`; a * adds the factors and their full interaction."""
    left, tilde, right = text.rpartition("~")
    terms: list[tuple[str, ...]] = []
    intercept = True
    for sign, term in re.findall(r"([+-]?)\s*([^+-]+)", right):
        term = term.strip()
        if not term:
            continue
        minus = sign == "-"
        if term in ("0", "1"):
            intercept = (term == "1") != minus
            continue
        factors = tuple(x.strip() for x in re.split(r"[*:]", term))
        found = [(f,) for f in factors] + [factors] if "*" in term and len(factors) > 1 else [factors]
        for f in found:
            if minus:
                terms = [t for t in terms if t != f]
            elif f not in terms:
                terms.append(f)
    return Formula(left.strip() or None if tilde else None, tuple(terms), intercept)


def design_matrix(df: DataFrame, formula: Formula | str, keys: list[str]) -> DataFrame:
    """keys, intercept and a column for each term; interactions are products."""
    f = parse_formula(formula) if isinstance(formula, str) else formula
    columns = [F.lit(1.0).alias("intercept")] if f.intercept else []
    for t in f.terms:
        product: Column = F.col(f"`{t[0]}`").cast("double")
        for x in t[1:]:
            product = product * F.col(f"`{x}`").cast("double")
        columns.append(product.alias(":".join(t)))
    return df.select(*keys, *columns)


def contrast_vector(conditions: list[str], weights: list[float], columns: list[str]) -> list[float]:
    """Weights in the places of their conditions among the columns, 0 elsewhere."""
    at = dict(zip(conditions, weights, strict=True))
    return [float(at.get(c, 0.0)) for c in columns]


def apply_contrast(design: DataFrame, conditions: list[str], weights: list[float], name: str) -> DataFrame:
    """design and the weighted sum of its columns."""
    total = F.lit(0.0)
    for c, w in zip(design.columns, contrast_vector(conditions, weights, design.columns), strict=True):
        if w:
            total = total + F.col(f"`{c}`") * w
    return design.withColumn(name, total)


def regressors(events: DataFrame, keys: list[str], *, frames: int, tr: float, model: str = "spm", oversampling: int = 50, delays: list[int] = ()) -> DataFrame:
    """keys, frame and a column for each kernel: the events' boxcars on a fine grid, convolved, taken at the frames.

    A boxcar is convolved as the difference of the kernel's running sum at its two ends, so an event costs a row for each
    frame from its start on, not one for each fine sample. Frames that only events of amplitude 0 reach are there too.
    """
    dt, n = tr / oversampling, frames * oversampling
    ks = hrf.kernels(model, tr, oversampling, delays)
    start = F.least(F.round(F.col("onset") / dt), F.lit(n - 1)).cast("int")
    end = F.least(F.round((F.col("onset") + F.col("duration")) / dt), F.lit(n - 1)).cast("int")
    #: Events without length are impulses of one fine sample.
    e = events.select(*keys, start.alias("_a"), F.greatest(end, start + 1).alias("_b"), F.col("amplitude").cast("double").alias("_x"))
    #: The two ends stay together: past the response their sums are one number, whose difference is 0 without any remainder.
    boxes = e.groupBy(*keys, "_a", "_b").agg(F.sum("_x").alias("_x"))
    rows = boxes.where(F.col("_a") <= (frames - 1) * oversampling).withColumn("frame", F.explode(F.sequence(F.greatest(F.ceil(F.col("_a") / oversampling).cast("int"), F.lit(0)), F.lit(frames - 1))))
    at = F.col("frame") * oversampling
    out = []
    for i, k in enumerate(ks):
        sums, total = [], 0.0
        for x in k:
            total += x
            sums.append(total)
        table = F.lit(sums)
        upto = lambda lag: F.when(lag < 0, 0.0).otherwise(F.get(table, F.least(lag, F.lit(len(sums) - 1))))  # noqa: B023, E731
        out.append(F.sum(F.col("_x") * (upto(at - F.col("_a")) - upto(at - F.col("_b")))).alias(f"regressor_{i}"))
    return rows.groupBy(*keys, "frame").agg(*out)


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r of each pair of columns; 0 where it isn't defined. One aggregation."""
    pairs = list(combinations(names, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"r{k}"), F.lit(0.0)).alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(made).alias("x")).select("x.*")


def vif_approx(df: DataFrame, names: list[str]) -> DataFrame:
    """name, vif: 1 / (1 - the sum of squared correlations with the other columns), infinite from 1 on."""
    c = correlations(df, names)
    both = c.select(F.col("a").alias("name"), "r").union(c.select("b", "r"))
    return both.groupBy("name").agg(F.sum(F.col("r") * F.col("r")).alias("s")).select("name", F.when(F.col("s") < 1, 1 / (1 - F.col("s"))).otherwise(F.lit(float("inf"))).alias("vif"))


def auto_model(events: DataFrame, task: str, factor: str) -> DataFrame:
    """task, factors: the sorted levels that a task's model has."""
    return events.groupBy(task).agg(F.array_join(F.transform(F.array_sort(F.collect_set(factor)), lambda x: F.concat(F.lit(f"{factor}."), x)), ",").alias("factors"))


@dataclass
class Node:
    """One level of a model: its grouping, transformations, design and contrasts."""

    name: str
    level: str = "run"
    group_by: list[str] = field(default_factory=list)
    transformations: list[dict] = field(default_factory=list)
    x: list = field(default_factory=list)
    contrasts: list[dict] = field(default_factory=list)
    dummies: list[str] = field(default_factory=list)


@dataclass
class Graph:
    """Nodes and edges (source, destination, filter) of a model."""

    nodes: dict[str, Node]
    edges: list[tuple[str, str, dict]]

    @staticmethod
    def from_json(spec: dict) -> Graph:
        """Reads a model; keys in either case. Without edges, each node feeds the next."""
        low = lambda d: {re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", k).lower(): v for k, v in d.items()}
        top = low(spec)
        nodes = {}
        for raw in map(low, top["nodes"]):
            x = low(raw.get("model", {})).get("x", [])
            dummy = low(raw.get("dummy_contrasts", {}) or {})
            ts = raw.get("transformations", [])
            ts = low(ts).get("instructions", []) if isinstance(ts, dict) else ts
            nodes[raw["name"]] = Node(raw["name"], raw.get("level", "run").lower(), raw.get("group_by", []), ts, x, [low(c) for c in raw.get("contrasts", [])], dummy.get("conditions", []) if dummy else [])
        edges = [(e["source"], e["destination"], e.get("filter", {})) for e in map(low, top.get("edges", []))]
        if not edges:
            chain = list(nodes)
            edges = [(a, b, {}) for a, b in zip(chain, chain[1:])]
        g = Graph(nodes, edges)
        g.order()
        return g

    def order(self) -> list[str]:
        """The nodes so that sources come before destinations; a cycle or an unknown node raises."""
        for a, b, _ in self.edges:
            if a not in self.nodes or b not in self.nodes:
                raise ValueError(f"edge {a} -> {b} names an unknown node")
        done: list[str] = []
        while len(done) < len(self.nodes):
            ready = [n for n in self.nodes if n not in done and all(a in done for a, b, _ in self.edges if b == n)]
            if not ready:
                raise ValueError("the model has a cycle")
            done += ready
        return done

    def dot(self) -> str:
        """The graph in the DOT language."""
        lines = [f'  "{n.name}" [label="{n.name}\\n{n.level}"];' for n in self.nodes.values()]
        return "\n".join(["digraph model {", *lines, *(f'  "{a}" -> "{b}";' for a, b, _ in self.edges), "}"])

    @staticmethod
    def _filtered(df: DataFrame, values: dict) -> DataFrame:
        for k, v in values.items():
            df = df.where(F.col(k).isin(v)) if k in df.columns else df
        return df

    def run(self, data: DataFrame | Collection | dict[str, DataFrame | Collection], keys: list[str]) -> dict[str, DataFrame]:
        """Each node's design with its contrasts, in order: of the rows of all its inputs, transformed within its groups.

        data may be a table or collection for each level: a node without inputs reads its own level's, one with inputs gets its
        level's variables beside them, by the keys that both have. A collection's instructions may turn sparse variables
        into dense ones.
        """
        by_level = data if isinstance(data, dict) else {}
        out = {}
        for name in self.order():
            node = self.nodes[name]
            inputs = [(out[a], f) for a, b, f in self.edges if b == name]
            own = by_level.get(node.level) if by_level else (data if not inputs else None)
            if not inputs and own is None:
                raise ValueError(f"node {name}: there are no variables of level {node.level}")
            instructions = node.transformations
            if isinstance(own, Collection):
                own, instructions = own.run(instructions).table(), []
            df = own if not inputs else variables.merged([self._filtered(d, f) for d, f in inputs])
            if inputs and own is not None:
                common = [k for k in keys if k in df.columns and k in own.columns]
                df = df.join(own.select(*common, *[c for c in own.columns if c not in df.columns]), common, "left")
            order = [k for k in keys if k in df.columns]
            have = [k for k in dict.fromkeys([*keys, *node.group_by]) if k in df.columns]
            df = variables.transform(df, instructions, order, [k for k in node.group_by if k in df.columns])
            terms = tuple((str(t),) for t in node.x if t != 1)
            d = design_matrix(df, Formula(None, terms, 1 in node.x), have)
            for c in node.contrasts:
                d = apply_contrast(d, c["condition_list"], c["weights"], c["name"])
            for c in node.dummies:
                d = apply_contrast(d, [c], [1.0], f"dummy_{c}")
            out[name] = d
        return out


def glm_spec(df: DataFrame, names: list[str], keys: list[str], model: dict) -> tuple[DataFrame, dict]:
    """The columns of a linear model (missing values are 0) and its settings: kind glm or meta, family, link, formula."""
    low = {k.lower(): v for k, v in model.items()}
    settings = {"kind": low.get("type", "glm").lower(), "family": low.get("family", "gaussian"), "link": low.get("link", "identity"), "formula": low.get("formula")}
    have = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names]
    return df.select(*keys, *have), settings


def auto_models(events: DataFrame, files: DataFrame) -> DataFrame:
    """task, model (JSON): a run node of the trial types of each task, and a node for each higher level that has several values.

    events: task, trial_type; files: task, run, session, subject.
    """
    factors = events.groupBy("task").agg(F.transform(F.array_sort(F.collect_set("trial_type")), lambda x: F.concat(F.lit("trial_type."), x)).alias("x"))
    levels = files.groupBy("task").agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("run", "session", "subject")])
    node = lambda name, level: F.struct(F.lit(name).alias("Name"), F.lit(level).alias("Level"))
    higher = F.array_compact(F.array(F.when(F.col("n_session") > 1, node("session", "Session")), F.when(F.col("n_subject") > 1, node("subject", "Subject")), F.when(F.col("n_subject") > 1, node("dataset", "Dataset"))))
    first = F.struct(F.lit("run").alias("Name"), F.lit("Run").alias("Level"), F.struct(F.col("x").alias("X")).alias("Model"))
    return factors.join(levels, "task").select("task", F.to_json(F.struct(F.concat(F.lit("auto_"), "task").alias("Name"), first.alias("Run"), higher.alias("Higher"))).alias("model"))


def standardized(df: DataFrame, name: str, by: list[str]) -> Column:
    """A column in units of its deviation within groups."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(name) - F.avg(name).over(w), F.stddev_samp(name).over(w))
