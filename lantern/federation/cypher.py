"""A subset of the graph query language, compiled to joins over edge tables.

Covered: MATCH with node labels and property maps, directed, reversed and undirected relationships,
alternation, bounded variable length, several patterns that share variables, OPTIONAL MATCH; WHERE
with comparisons, IN, IS [NOT] NULL and [NOT] EXISTS; WITH ... WHERE on aggregates; RETURN [DISTINCT]
of properties, whole nodes, COUNT, SUM, AVG, MIN, MAX and collect, ORDER BY, SKIP and LIMIT;
parameters; CALL db.labels(), db.relationshipTypes() and db.propertyKeys(). Within one MATCH no relationship is
used twice. What is not covered raises CypherError when the query is compiled, before anything runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import both_ways, shortest_path


class CypherError(ValueError):
    pass


@dataclass
class GraphSource:
    """Nodes by label with their key column; edges by type with src, dst and properties, and the labels of their ends."""

    nodes: dict[str, tuple[DataFrame, str]]
    edges: dict[str, tuple[str, str, DataFrame]]


_NODE = re.compile(r"\(\s*(?P<var>\w+)?\s*(?::\s*(?P<label>\w+))?\s*(?P<props>\{[^}]*\})?\s*\)")
_REL = re.compile(r"(?P<left><)?-\s*(?:\[\s*(?P<var>\w+)?\s*(?::\s*(?P<types>[\w|:]+))?\s*(?P<star>\*\s*(?P<low>\d+)?\s*(?:\.\.\s*(?P<high>\d+)?)?)?\s*\])?\s*-\s*(?P<right>>)?")
_CLAUSE = re.compile(r"\b(OPTIONAL MATCH|MATCH|WITH|WHERE|RETURN|ORDER BY|SKIP|LIMIT)\b", re.I)
_AGG = re.compile(r"^(count|sum|avg|min|max|collect)\s*\(\s*(distinct\s+)?(.+?)\s*\)$", re.I)


def _split(text: str, by: str = ",") -> list[str]:
    """text at top-level separators: outside brackets and quotes."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == by and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _clauses(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"//[^\n]*", " ", text)
    marks, depth, quote = [], 0, ""
    for m in re.finditer(r"['\"{}()\[\]]|" + _CLAUSE.pattern, text, re.I):
        s = m[0]
        if quote:
            quote = "" if s == quote else quote
        elif s in "'\"":
            quote = s
        elif s in "{([":
            depth += 1
        elif s in "})]":
            depth -= 1
        elif not depth:
            marks.append((m.start(), m.end(), " ".join(s.upper().split())))
    if not marks or text[: marks[0][0]].strip():
        raise CypherError(f"cannot read: {text.strip()[:60]}")
    ends = [a for a, _, _ in marks[1:]] + [len(text)]
    return [(k, text[b:e].strip().rstrip(";")) for (_, b, k), e in zip(marks, ends)]


@dataclass
class _State:
    """A table of bindings: the key of each node variable, the properties of each relationship variable."""

    df: DataFrame | None = None
    labels: dict[str, str] = field(default_factory=dict)
    rels: dict[str, list[str]] = field(default_factory=dict)
    used: list[tuple[str, Column]] = field(default_factory=list)
    n: int = 0


class Compiler:
    def __init__(self, graph: GraphSource, params: dict | None = None):
        self.g, self.params = graph, params or {}

    def compile(self, text: str) -> DataFrame:
        found = re.search(r"shortestPath\s*\(\s*(\(.*?\))\s*-\s*\[[^\]]*\]\s*-\s*(\(.*?\))\s*\)\s*RETURN\s+length\(\w+\)\s+AS\s+(\w+)", text, re.I | re.S)
        if found:
            return self._shortest(*found.groups())
        state, out = _State(), None
        call = re.match(r"\s*CALL\s+db\.(\w+)\s*\(\s*\)(?:\s+YIELD\s+(\w+)(?:\s+AS\s+(\w+))?)?", text, re.I)
        if call:
            out, text = self._call(*call.groups()), text[call.end() :]
            if not text.strip():
                return out
        parts = _clauses(text)
        order: list[str] = []
        done = -1
        for i, (kind, body) in enumerate(parts):
            if i <= done:
                continue
            if kind == "MATCH":
                state.used = []
                self._patterns(state, body)
            elif kind == "OPTIONAL MATCH":
                # A condition that follows belongs to the optional part.
                done = i + 1 if i + 1 < len(parts) and parts[i + 1][0] == "WHERE" else i
                self._optional(state, body, parts[done][1] if done > i else None)
            elif kind == "WHERE":
                target = out if out is not None else state
                if out is not None:
                    out = out.where(self._having(body))
                else:
                    self._where(target, body)
            elif kind in ("WITH", "RETURN"):
                out = self._project(state if out is None else None, out, body, kind == "RETURN")
            elif kind == "ORDER BY":
                order = _split(body)
                if i + 1 == len(parts):
                    out = out.orderBy(*self._order(out, order))
            elif kind == "SKIP":
                out = out.orderBy(*self._order(out, order)).offset(self._number(body))
            elif kind == "LIMIT":
                # Every other column breaks ties, so a limit always keeps the same rows.
                out = out.orderBy(*self._order(out, order)).limit(self._number(body))
        if out is None:
            raise CypherError("nothing is returned")
        return out

    def _call(self, procedure: str, column: str | None, name: str | None) -> DataFrame:
        """What the graph knows of itself, as a table of one column."""
        known = {
            "labels": ("label", sorted(self.g.nodes)),
            "relationshiptypes": ("relationshipType", sorted(self.g.edges)),
            "propertykeys": ("propertyKey", sorted({c for df, _ in self.g.nodes.values() for c in df.columns} | {c for _, _, df in self.g.edges.values() for c in df.columns if c not in ("src", "dst")})),
        }
        if procedure.lower() not in known or (column and column != known[procedure.lower()][0]):
            raise CypherError(f"no procedure db.{procedure} that yields {column}")
        own, values = known[procedure.lower()]
        some = next(iter(self.g.nodes.values()))[0]
        return some.sparkSession.createDataFrame([(v,) for v in values], f"`{name or own}` string")

    def _patterns(self, state: _State, body: str) -> None:
        """The patterns of one MATCH, each as soon as it shares a variable with what is bound."""
        todo = [p.strip() for p in _split(body)]
        while todo:
            bound = set(state.df.columns) if state.df is not None else set()
            following = next((p for p in todo if not bound or bound & {m["var"] for m in _NODE.finditer(p) if m["var"]}), None)
            if following is None:
                raise CypherError("patterns that share no variable are not covered")
            todo.remove(following)
            self._pattern(state, following)

    def _optional(self, state: _State, body: str, where: str | None) -> None:
        """Rows stay as they are where the pattern is not met; what it would bind is null then."""
        names = {m["var"] for m in _NODE.finditer(body) if m["var"]}
        shared = sorted(names & set(state.df.columns)) if state.df is not None else []
        if not shared:
            raise CypherError("OPTIONAL MATCH needs a bound variable")
        inner = _State(df=state.df.select(*shared).distinct(), labels={v: state.labels[v] for v in shared}, n=state.n)
        self._patterns(inner, body)
        if where:
            self._where(inner, where)
        new = [c for c in inner.df.columns if c not in shared and (c in inner.labels or c in inner.rels) and not c.startswith("_")]
        state.df = state.df.join(inner.df.select(*shared, *new), shared, "left")
        state.labels.update(inner.labels)
        state.rels.update(inner.rels)
        state.n = inner.n

    def _number(self, text: str) -> int:
        return int(self._value(text))

    def _value(self, text: str):
        text = text.strip()
        if text.startswith("$"):
            if text[1:] not in self.params:
                raise CypherError(f"no parameter {text}")
            return self.params[text[1:]]
        if text[:1] in "'\"":
            return text[1:-1]
        if text.startswith("["):
            return [self._value(x) for x in _split(text[1:-1]) if x.strip()]
        if text.lower() in ("true", "false"):
            return text.lower() == "true"
        try:
            return float(text) if "." in text else int(text)
        except ValueError:
            raise CypherError(f"cannot read value {text}") from None

    def _props(self, text: str | None) -> dict:
        return {k.strip(): self._value(v) for k, v in (x.split(":", 1) for x in _split(text[1:-1]))} if text else {}

    def _node(self, state: _State, m: re.Match, implied: str | None = None) -> str:
        """The variable of a node, bound and filtered; implied is the label its relationship gives it."""
        state.n += 1
        var = m["var"] or f"_n{state.n}"
        label = m["label"] or state.labels.get(var) or implied
        known = state.df is not None and var in state.df.columns
        if not known:
            if label is None:
                raise CypherError("a node needs a label or a relationship")
            df, key = self.g.nodes[label] if label in self.g.nodes else (None, None)
            if df is None:
                raise CypherError(f"no label {label}")
            if state.df is not None:
                raise CypherError("patterns that share no variable are not covered")
            state.df = df.select(F.col(key).alias(var)).distinct()
        state.labels.setdefault(var, label)
        for k, v in self._props(m["props"]).items():
            self._keep(state, self._property(state, var, k) == F.lit(v))
        return var

    def _keep(self, state: _State, condition: Column) -> None:
        """Filters after the condition was built: building it may have joined the property it reads."""
        state.df = state.df.where(condition)

    def _property(self, state: _State, var: str, name: str) -> Column:
        if var in state.rels:
            if name not in state.rels[var]:
                raise CypherError(f"{var} has no {name}")
            return F.col(f"{var}.{name}")
        if var not in state.labels:
            raise CypherError(f"{var} is not bound")
        df, key = self.g.nodes[state.labels[var]]
        if name == key:
            return F.col(var)
        column = f"_p_{var}_{name}"
        if column not in state.df.columns:
            if name not in df.columns:
                raise CypherError(f"{state.labels[var]} has no {name}")
            state.df = state.df.join(df.select(F.col(key).alias(var), F.col(name).alias(column)).dropDuplicates([var]), var, "left")
        return F.col(column)

    def _pattern(self, state: _State, text: str) -> None:
        m = _NODE.match(text)
        if not m:
            raise CypherError(f"cannot read pattern {text[:60]}")
        first, at, left = m, m.end(), None
        bound = m["var"] and state.df is not None and m["var"] in state.df.columns
        if not text[at:].strip() or bound or (m["props"] and state.df is None):
            left = self._node(state, m) if (m["label"] or bound) else None
        while text[at:].strip():
            r = _REL.match(text, at)
            nxt = r and _NODE.match(text, r.end())
            if not nxt:
                raise CypherError(f"cannot read pattern {text[at:][:60]}")
            left = self._expand(state, first, left, r, nxt)
            first, at = nxt, nxt.end()

    def _edges(self, r: re.Match) -> tuple[DataFrame, str, str, list[str]]:
        types = [t for t in re.split(r"[|:]+", r["types"] or "") if t] or list(self.g.edges)
        unknown = [t for t in types if t not in self.g.edges]
        if unknown:
            raise CypherError(f"no relationship {unknown[0]}")
        out, props = None, sorted({c for t in types for c in self.g.edges[t][2].columns} - {"src", "dst"})
        for t in types:
            df = self.g.edges[t][2]
            one = df.select("src", "dst", F.struct(F.lit(t).alias("t"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).alias("_e"), *[F.col(p) if p in df.columns else F.lit(None).alias(p) for p in props])
            out = one if out is None else out.unionByName(one)
        ends = [(self.g.edges[t][0], self.g.edges[t][1]) for t in types]
        if not (r["left"] or r["right"]):
            out = both_ways(out)
        elif r["left"]:
            out = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in out.columns if c not in ("src", "dst")])
            ends = [(b, a) for a, b in ends]
        return out, ends[0][0], ends[0][1], props

    def _expand(self, state: _State, start: re.Match, left: str | None, r: re.Match, end: re.Match) -> str:
        edges, from_label, to_label, props = self._edges(r)
        low, high = (1, 1) if not r["star"] else (int(r["low"] or 1), int(r["high"] or r["low"] or 0))
        if not high:
            raise CypherError("a variable length needs an upper bound")
        state.n += 1
        a, e, b = left or start["var"] or f"_n{state.n}", f"_r{state.n}", end["var"] or f"_m{state.n}"
        steps = edges.select(F.col("src").alias(a), F.array("_e").alias(e), F.col("dst").alias("_to"), *([F.struct(*props).alias(r["var"])] if r["var"] and props and high == 1 else []))
        if high > 1:
            walk, all_ = steps, steps if low == 1 else None
            for k in range(2, high + 1):
                more = edges.select(F.col("src").alias("_via"), F.col("_e").alias("_next"), F.col("dst").alias("_then"))
                walk = walk.join(more, F.col("_to") == F.col("_via")).where(~F.array_contains(e, F.col("_next"))).select(a, F.concat(e, F.array("_next")).alias(e), F.col("_then").alias("_to"))
                if k >= low:
                    all_ = walk if all_ is None else all_.unionByName(walk)
            steps = all_
        known = state.df is not None and b in state.df.columns
        steps = steps.withColumnRenamed("_to", "_end" if known else b)
        if state.df is None:
            state.df = steps
        elif a in state.df.columns:
            state.df = state.df.join(steps, [a])
        elif known:
            state.df = state.df.join(steps, F.col(b) == F.col("_end"))
        else:
            raise CypherError("write the pattern from a bound variable on")
        if known:
            state.df = state.df.where(F.col(b) == F.col("_end")).drop("_end")
        for other in state.used:
            state.df = state.df.where(F.size(F.array_intersect(F.col(e), F.col(other[0]))) == 0)
        state.used.append((e, F.col(e)))
        if r["var"] and props:
            state.rels[r["var"]] = props
        state.labels.setdefault(a, start["label"] or from_label)
        for k, v in (self._props(start["props"]) if left is None else {}).items():
            self._keep(state, self._property(state, a, k) == F.lit(v))
        state.labels.setdefault(b, end["label"] or to_label)
        for k, v in self._props(end["props"]).items():
            self._keep(state, self._property(state, b, k) == F.lit(v))
        return b

    def _where(self, state: _State, text: str) -> None:
        for cond in re.split(r"\s+AND\s+(?![^{]*\})", text.strip(), flags=re.I):
            exists = re.match(r"(NOT\s+)?EXISTS\s*\{\s*(?:MATCH\s+)?(.*)\}$", cond.strip(), re.I | re.S)
            if exists:
                m = _NODE.match(exists[2].strip())
                inner = _State()
                if not m or not m["var"]:
                    raise CypherError("EXISTS needs a bound variable first")
                self._pattern(inner, exists[2].strip().replace(m[0], f"({m['var']}:{state.labels.get(m['var'])})", 1))
                state.df = state.df.join(inner.df.select(m["var"]).distinct(), m["var"], "left_anti" if exists[1] else "left_semi")
                continue
            m = re.match(r"(\w+)\.(\w+)\s*(<>|>=|<=|=|>|<|\bIN\b|IS NOT NULL|IS NULL|CONTAINS|STARTS WITH)\s*(.*)$", cond.strip(), re.I | re.S)
            if not m:
                raise CypherError(f"cannot read condition {cond[:60]}")
            self._keep(state, self._compare(self._property(state, m[1], m[2]), m[3].upper(), m[4], state))

    def _compare(self, left: Column, op: str, right: str, state: _State | None) -> Column:
        if op == "IS NULL":
            return left.isNull()
        if op == "IS NOT NULL":
            return left.isNotNull()
        other = re.fullmatch(r"(\w+)\.(\w+)", right.strip())
        value = self._property(state, other[1], other[2]) if other and state and not right.strip()[0].isdigit() else self._value(right)
        if op == "IN":
            return left.isin(*value)
        if op == "CONTAINS":
            return left.contains(value)
        if op == "STARTS WITH":
            return left.startswith(value)
        return {"=": left == value, "<>": left != value, ">": left > value, "<": left < value, ">=": left >= value, "<=": left <= value}[op]

    def _having(self, text: str) -> Column:
        out = F.lit(True)
        for cond in re.split(r"\s+AND\s+", text.strip(), flags=re.I):
            m = re.match(r"(\w+)\s*(<>|>=|<=|=|>|<)\s*(.*)$", cond.strip())
            if not m:
                raise CypherError(f"cannot read condition {cond[:60]}")
            out = out & self._compare(F.col(m[1]), m[2], m[3], None)
        return out

    def _expression(self, state: _State | None, df: DataFrame | None, text: str) -> Column:
        m = re.fullmatch(r"(\w+)\.(\w+)", text)
        if m and state is not None:
            return self._property(state, m[1], m[2])
        if m:
            # After WITH a node is its key, the only property that is carried.
            return F.col(m[1])
        if (state is not None and (text in state.labels or text in state.rels)) or (df is not None and text in df.columns):
            return F.col(text)
        raise CypherError(f"cannot read expression {text}")

    def _whole(self, state: _State, var: str) -> Column:
        """A node with all its properties."""
        df, key = self.g.nodes[state.labels[var]]
        column = f"_s_{var}"
        if column not in state.df.columns:
            state.df = state.df.join(df.select(F.col(key).alias(var), F.struct(*df.columns).alias(column)).dropDuplicates([var]), var, "left")
        return F.col(column)

    def _project(self, state: _State | None, df: DataFrame | None, text: str, last: bool = True) -> DataFrame:
        distinct = re.match(r"DISTINCT\s+", text, re.I)
        keys, aggs, names = [], [], []
        for item in _split(text[distinct.end() :] if distinct else text):
            m = re.match(r"(.+?)(?:\s+AS\s+(\w+))?$", item.strip(), re.I | re.S)
            expr, name = m[1].strip(), m[2] or re.sub(r"\W+", "_", m[1].strip())
            names.append(name)
            agg = _AGG.match(expr)
            if not agg:
                node = last and state is not None and expr in state.labels
                keys.append((self._whole(state, expr) if node else self._expression(state, df, expr)).alias(name))
                continue
            f, inner = agg[1].lower(), F.lit(1) if agg[3] == "*" else self._expression(state, df, agg[3])
            if agg[2]:
                inner_agg = {"count": F.countDistinct, "collect": F.collect_set, "sum": F.sum_distinct}.get(f)
                if inner_agg is None:
                    raise CypherError(f"{f} of distinct values is not covered")
                aggs.append(inner_agg(inner).alias(name))
            else:
                aggs.append({"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}[f](inner).alias(name))
        rows = state.df if state is not None else df
        if aggs:
            rows = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
        else:
            rows = rows.select(*keys)
        return (rows.distinct() if distinct else rows).select(*names)

    def _order(self, df: DataFrame, items: list[str]) -> list[Column]:
        out, seen = [], set()
        for item in items:
            m = re.match(r"([\w.]+)(?:\s+(ASC|DESC)\w*)?$", item.strip(), re.I)
            name = re.sub(r"\W+", "_", m[1]) if m else ""
            if name not in df.columns:
                raise CypherError(f"cannot order by {item.strip()}")
            seen.add(name)
            out.append(F.col(name).desc_nulls_first() if (m[2] or "").upper() == "DESC" else F.col(name).asc_nulls_last())
        return out + [F.col(c) for c in df.columns if c not in seen]

    def _shortest(self, a: str, b: str, name: str) -> DataFrame:
        ends, out = [], None
        for text in (a, b):
            m = _NODE.match(text)
            key = self._props(m["props"])
            ends.append(f"{m['label']}:{next(iter(key.values()))}")
        for t, (s, d, df) in self.g.edges.items():
            one = df.select(F.concat(F.lit(s + ":"), F.col("src").cast("string")).alias("src"), F.concat(F.lit(d + ":"), F.col("dst").cast("string")).alias("dst"))
            out = one if out is None else out.unionByName(one)
        n = shortest_path(out, *ends)
        return out.sparkSession.createDataFrame([(n,)] if n is not None else [], f"{name} int")


def run(graph: GraphSource, text: str, **params) -> DataFrame:
    """The result of a graph query as a DataFrame."""
    return Compiler(graph, params).compile(text)
