"""Statements folded into a memory: how each relates to what a tenant already knows.

Order decides, so the fold runs tenant by tenant in the order of ``seq``; a tenant's live memories have
to fit one task. Each statement looks up its exact match, its fact's domain and its lineage in dictionaries;
vectors meet in one product for CHUNK statements. The same fold serves batches
(:func:`evolve`) and streams (:func:`tessera.streaming.evolution.evolve_stream`). Facts are extracted
before the fold, in parallel and once for each statement.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import extraction
from tessera.functions import text as X
from tessera.functions.scoring import IMPORTANCE, SINGLE_VALUED, SINGLE_VALUED_TYPES
from tessera.scale import materialize

SEMANTIC_POOL, STRUCTURAL_POOL, WIDE_POOL = 5, 50, 50
#: Statements whose vectors meet the stored ones in one product, and the slack for its rounding.
CHUNK, ROUNDING = 512, 1e-5
# Cosine distances of the classes, the action of each decision, longest keys of the fact index.
NEAR, RELATED, MERGE, SAME = 0.10, 0.35, 0.08, 0.10
ACTIONS = {"NEW": "store", "REINFORCEMENT": "reinforce", "MERGE": "merge", "SUPERSESSION": "update", "CONTRADICTION": "archive", "RELATED": "store", "UPDATE": "update"}
KEY_LIMITS = {"entity": 255, "attribute": 128, "value": 255}
Key = tuple[str, str, str]


def norm(x: str) -> str:
    return x.strip().lower()


def key_of(fact: dict | None) -> Key | None:
    """(entity, attribute, value) in the form in which facts are compared; null without fact or attribute."""
    return (norm(fact["entity"]), norm(fact["attribute"]), norm(fact["value"])) if fact and fact["attribute"] else None


def indexed(fact: dict | None) -> bool:
    """Whether the fact index has a row for it: a told attribute, no question, keys that fit."""
    return bool(fact and fact["attribute"] and fact["attribute"] != extraction.NO_ATTRIBUTE and not fact["is_question"] and norm(fact["entity"]) and norm(fact["attribute"])) and all(len(norm(fact[k])) <= n for k, n in KEY_LIMITS.items())


@dataclass
class Memory:
    """A stored statement of one tenant."""

    id: int
    content: str
    category: str | None
    fact: dict | None
    vector: np.ndarray | None
    state: str = "active"
    importance: float = 0.5
    confidence: float = 1.0
    access_count: int = 0
    version: int = 1
    is_contradicted: bool = False
    contradicted_by_id: int | None = None
    key: Key | None = None
    slot: int = -1


@dataclass
class Store:
    """What a tenant knows: memories and lineage links, with what a statement looks up kept as dictionaries.

    ``put`` brings all of them up to a memory's content, fact, vector and state; it is to be called after
    every change of one of these.
    """

    memories: dict[int, Memory] = field(default_factory=dict)
    #: Lineage links (source, target, type) by each of their ends, and what they make of a memory.
    links: dict[int, set[tuple[int, int, str]]] = field(default_factory=dict)
    past: set[int] = field(default_factory=set)
    #: Ids by content; ids of live rows of the fact index, ascending, by (entity, attribute) and with the value.
    texts: dict[str, list[int]] = field(default_factory=dict)
    domains: dict[tuple, list[int]] = field(default_factory=dict)
    entered: dict[int, tuple[str, Key | None]] = field(default_factory=dict)
    #: Unit vectors in slots; the slot of an older vector or of an archived memory is dead.
    units: np.ndarray | None = None
    owner: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    alive: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    used: int = 0

    def put(self, m: Memory) -> None:
        self.memories[m.id] = m
        m.key = key_of(m.fact)
        competes = m.state != "archived" and not m.is_contradicted and m.id not in self.past and indexed(m.fact) and not m.fact["is_placeholder"]
        want = (m.content, m.key if competes else None)
        had = self.entered.get(m.id)
        if had != want:
            if had:
                self._move(had, m.id, False)
            self._move(want, m.id, True)
            self.entered[m.id] = want
        if m.slot >= 0:
            self.alive[m.slot] = False
        if m.vector is None or m.state == "archived":
            m.slot = -1
            return
        if self.used == len(self.owner):
            size = max(64, 2 * self.used)
            units = np.zeros((size, len(m.vector)), np.float32)
            if self.units is not None:
                units[: self.used] = self.units
            self.units, self.owner, self.alive = units, np.append(self.owner, np.zeros(size - self.used, np.int64)), np.append(self.alive, np.zeros(size - self.used, bool))
        m.slot, self.used = self.used, self.used + 1
        self.units[m.slot], self.owner[m.slot], self.alive[m.slot] = _unit(m.vector), m.id, True

    def _move(self, entry: tuple[str, Key | None], i: int, enter: bool) -> None:
        content, key = entry
        for where, k in ((self.texts, content), *(((self.domains, key[:2]), (self.domains, key)) if key else ())):
            ids = where.setdefault(k, [])
            at = bisect_left(ids, i)
            if enter:
                ids.insert(at, i)
            else:
                del ids[at]

    def link(self, source: int, target: int, kind: str) -> None:
        one = (source, target, kind)
        for end in (source, target):
            self.links.setdefault(end, set()).add(one)
        if kind in ("superseded_by", "fulfilled_by"):
            self.past.add(source)
            self.put(self.memories[source])

    def relink(self, old: int, new: int) -> None:
        """All links of ``old`` become links of ``new``; links to itself go."""
        for s, t, k in self.links.pop(old, set()):
            self.links.get(t if s == old else s, set()).discard((s, t, k))
            s, t = (new if x == old else x for x in (s, t))
            if s != t:
                self.link(s, t, k)
        self.past.discard(old)

    def all_links(self) -> list[tuple[int, int, str]]:
        return sorted({x for links in self.links.values() for x in links})

    def nearest(self, vector: np.ndarray, pool: int, known: np.ndarray | None = None) -> list[tuple[Memory, float]]:
        """The ``pool`` nearest live memories by cosine distance, then id.

        ``known`` has the products with the first slots; the others are multiplied here. The edge of the
        pool is scored exactly, as the products are rounded.
        """
        n, unit = self.used, _unit(vector)
        if not n:
            return []
        old = 0 if known is None else len(known)
        near = np.concatenate([known if old else np.empty(0, np.float32), self.units[old:n] @ unit])
        near[~self.alive[:n]] = -3
        k = min(pool, n)
        edge = np.partition(near, n - k)[n - k]
        close = [self.memories[int(i)] for i in self.owner[np.flatnonzero((near >= edge - ROUNDING) & (near > -2))]]
        scored = sorted(((1 - float(vector @ m.vector / (np.linalg.norm(vector) * np.linalg.norm(m.vector) or 1)), m.id, m) for m in close), key=lambda x: x[:2])
        return [(m, x) for x, _, m in scored[:pool]]


def _unit(vector: np.ndarray) -> np.ndarray:
    return (vector / (np.linalg.norm(vector) or 1)).astype(np.float32)


def single_valued(fact: dict) -> bool:
    a = norm(fact["attribute"])
    return a in SINGLE_VALUED or a.startswith("favorite_") or fact["fact_type"] in SINGLE_VALUED_TYPES


def same_domain(a: dict | None, b: dict | None) -> bool:
    x, y = key_of(a), key_of(b)
    return x is not None and y is not None and x[:2] == y[:2]


def in_transition(content: str) -> bool:
    return extraction._cue(content, X.TRANSITION_CUES)


def contradicts(new: dict | None, content: str, old: dict | None) -> bool:
    """Two current claims of one single-valued domain with different values, and no move told."""
    if not same_domain(new, old) or norm(new["value"]) == norm(old["value"]) or not single_valued(new):
        return False
    past_or_plan = {"FUTURE", "HISTORICAL"} & {new["temporal_state"], old["temporal_state"]}
    return not in_transition(content) and not past_or_plan


def first_contradicted(new: dict | None, content: str, candidates: Iterable[tuple[Memory, float | None]], historical: set[int] = frozenset()) -> Memory | None:
    """The first candidate that the statement contradicts, whatever else would be decided."""
    return next((m for m, _ in candidates if m.id not in historical and contradicts(new, content, m.fact)), None)


def equivalent(new: dict | None, content: str, old: Memory, distance: float | None) -> bool:
    """Whether a statement can be merged into a memory."""
    if contradicts(new, content, old.fact):
        return False
    if norm(content) == norm(old.content):
        return True
    if new and old.fact and new["attribute"] and old.fact["attribute"]:
        if key_of(new) != key_of(old.fact):
            return False
        plans = (new["temporal_state"] == "FUTURE") != (old.fact["temporal_state"] == "FUTURE")
        return not (new["is_negated"] or old.fact["is_negated"] or plans)
    a, b = set(norm(content).split()), set(norm(old.content).split())
    return (distance is None or distance < MERGE) and bool(a | b) and len(a & b) / len(a | b) >= 0.35


def assess(new: dict | None, content: str, candidates: list[tuple[Memory, float | None]], historical: set[int]) -> tuple[str, Memory | None, list[str]]:
    """(decision, target, reasons) of a statement among candidates in their order."""
    decision, target, reasons = _first_verdict(new, content, candidates, historical)
    if decision in ("NEW", "RELATED") and (hit := first_contradicted(new, content, candidates, historical)):
        return "CONTRADICTION", hit, ["contradiction_detector", "conflicting_current_claims"]
    return decision, target, reasons


def _first_verdict(new: dict | None, content: str, candidates: list[tuple[Memory, float | None]], historical: set[int]) -> tuple[str, Memory | None, list[str]]:
    if not candidates:
        return "NEW", None, ["no_candidates"]
    live = [(m, d) for m, d in candidates if m.id not in historical]
    if new and new["attribute"]:
        many = not single_valued(new)
        about = ["same_entity", "same_attribute"]
        differs = [*about, "different_value", "multi_valued_attribute" if many else "single_valued_attribute"]
        for m, _ in live:
            old = m.fact
            if not same_domain(new, old):
                continue
            if norm(old["value"]) == norm(new["value"]):
                if new["is_negated"]:
                    return "SUPERSESSION", m, [*about, "same_value", "negation_detected"]
                continue
            if many or "FUTURE" in (new["temporal_state"], old["temporal_state"]):
                continue
            if in_transition(content):
                return "SUPERSESSION", m, [*differs, "transition_detected"]
            if new["temporal_state"] == "CURRENT":
                if old["temporal_state"] == "HISTORICAL":
                    return "SUPERSESSION", m, [*differs, "historical_to_current"]
                return "CONTRADICTION", m, [*differs, "conflicting_current_claims", "no_transition_evidence"]
    for m, d in live:
        if equivalent(new, content, m, d):
            exact = norm(content) == norm(m.content)
            return ("REINFORCEMENT", m, ["exact_content_match"]) if exact else ("MERGE", m, ["equivalent_fact"])
    if not live:
        return "NEW", None, ["only_historical_candidates"]
    m, d = live[0]
    if d is None:
        return "NEW", None, ["no_semantic_distance"]
    if d < NEAR:
        return "REINFORCEMENT", m, ["semantic_near_duplicate"]
    return ("RELATED", m, ["semantically_related"]) if d < RELATED else ("NEW", None, ["no_structured_or_semantic_match"])


def candidates_of(store: Store, fact: dict | None, vector: np.ndarray | None, known: np.ndarray | None = None) -> tuple[list[tuple[Memory, float | None]], set[int], bool]:
    """(candidates, ids that only the facts gave, whether the facts gave more than the pool).

    Nearest live memories come first, then the newest of the fact's domain, without a distance.
    """
    near: list[tuple[Memory, float | None]] = [] if vector is None else list(store.nearest(vector, SEMANTIC_POOL, known))
    if not indexed(fact) or fact["is_placeholder"]:
        return near, set(), False
    key = key_of(fact)
    ids, seen = store.domains.get(key[:2] if single_valued(fact) else key, []), {m.id for m, _ in near}
    more = [i for i in ids[: -STRUCTURAL_POOL - 1 : -1] if i not in seen]
    return [*near, *((store.memories[i], None) for i in more)], set(more), len(ids) > STRUCTURAL_POOL


def _strengthen(m: Memory, confidence: float = 0.0) -> Memory:
    m.importance, m.access_count = min(1.0, m.importance + 0.05), m.access_count + 1
    m.confidence = min(1.0, m.confidence + confidence)
    if m.state != "archived":
        m.state = "active" if m.access_count >= 3 else "weak"
    return m


@dataclass
class Statement:
    """A statement with what was read from it."""

    seq: int
    content: str
    category: str | None
    fact: dict | None
    vector: np.ndarray | None


def _insert(store: Store, s: Statement) -> Memory:
    m = Memory(s.seq, s.content, s.category, s.fact, s.vector, importance=IMPORTANCE.get((s.category or "").lower(), 0.40))
    store.put(m)
    return m


def _keep(store: Store, s: Statement, found: list[tuple[Memory, float | None]]) -> Memory:
    """The memory that has a claim: its exact match, else the nearest one if it is all but equal, else a new one.

    A contradicted exact match is a claim once more; one that was merged away stays archived.
    """
    same = [store.memories[i] for i in store.texts.get(s.content, []) if i not in store.past]
    if same:
        m = min(same, key=lambda m: (m.state == "archived", m.id))
        if m.state != "archived" or m.is_contradicted:
            if m.state == "archived":
                m.state, m.is_contradicted, m.contradicted_by_id, m.version = "active", False, None, m.version + 1
            _strengthen(m)
            store.put(m)
            return m
    if found and found[0][1] is not None and found[0][1] <= SAME:
        return _strengthen(found[0][0])
    return _insert(store, s)


def _overwrite(store: Store, m: Memory, s: Statement) -> None:
    m.content, m.category, m.fact, m.vector, m.version = s.content, s.category, s.fact, s.vector, m.version + 1
    m.is_contradicted, m.contradicted_by_id = False, None
    store.put(m)


def _contradict(store: Store, s: Statement, target: Memory | None) -> tuple[Memory, list[str]]:
    reasons = []
    if target is None:
        wide = store.nearest(s.vector, WIDE_POOL) if s.vector is not None else []
        target = first_contradicted(s.fact, s.content, wide, store.past)
        if target is None:
            return _keep(store, s, wide), ["contradiction_target_unresolved"]
        reasons = ["contradiction_target_resolved_by_wide_search"]
    memory = _keep(store, s, [])  # a competing claim is never folded into a similar one
    if memory.id == target.id:
        return memory, [*reasons, "reasserted_existing_memory"]
    target.state, target.is_contradicted, target.contradicted_by_id = "archived", True, memory.id
    target.confidence, target.version = max(0.0, target.confidence - 0.20), target.version + 1
    store.put(target)
    return memory, [*reasons, f"contradicted_memory:{target.id}"]


def _merge(store: Store, s: Statement, found: list[tuple[Memory, float | None]]) -> tuple[Memory, list[str]]:
    group = [m for m, d in found if m.id not in store.past and equivalent(s.fact, s.content, m, d)]
    if not group:
        return _keep(store, s, found), ["merge_candidates_unresolved"]
    memory, others = group[0], group[1:]
    memory.confidence = min(1.0, max(m.confidence for m in group) + 0.05)
    memory.access_count, memory.state = sum(m.access_count for m in group) + 1, "active"
    _overwrite(store, memory, s)
    for m in others:
        m.state, m.is_contradicted, m.contradicted_by_id, m.version = "archived", False, None, m.version + 1
        store.relink(m.id, memory.id)
        store.put(m)
    for m in others:
        store.link(m.id, memory.id, "merged_into")
    return memory, [f"merged_memory:{m.id}" for m in others]


def apply(store: Store, s: Statement, decision: str, target: Memory | None, found: list[tuple[Memory, float | None]]) -> tuple[Memory, list[str]]:
    """Change the store by a decision: (the memory that has the statement now, reasons).

    A decision that needs a target and has none keeps the statement as a claim of its own.
    """
    if decision == "CONTRADICTION":
        return _contradict(store, s, target)
    if decision == "MERGE":
        return _merge(store, s, found)
    if decision in ("NEW", "RELATED") or target is None:
        return _keep(store, s, found), [] if decision in ("NEW", "RELATED") else [f"{decision.lower()}_target_unresolved"]
    if decision == "SUPERSESSION":
        memory = _insert(store, s)
        target.version += 1
        store.link(target.id, memory.id, "superseded_by")
        return memory, [f"superseded_memory:{target.id}"]
    if decision == "UPDATE":
        target.confidence = min(1.0, target.confidence + 0.05)
        target.access_count += 1
        target.state = "active" if target.access_count >= 3 else "weak"
        _overwrite(store, target, Statement(s.seq, s.content, s.category or target.category, s.fact, s.vector))
        return target, []
    return _strengthen(target, 0.10), []


def _fulfil(store: Store, s: Statement, memory: Memory, found: list[tuple[Memory, float | None]], past: set[int]) -> list[str]:
    """Plans among the candidates that the statement tells to have come true."""
    f = s.fact
    if not f or f["temporal_state"] != "CURRENT" or f["is_negated"] or not f["attribute"]:
        return []
    done = []
    for m, _ in found:
        plan = m.fact
        if m.id != memory.id and m.id not in past and m.state != "archived" and plan and plan["temporal_state"] == "FUTURE" and not plan["is_negated"] and m.key == key_of(f):
            m.version += 1
            store.link(m.id, memory.id, "fulfilled_by")
            done.append(f"fulfilled_plan:{m.id}")
    return done


def step(store: Store, s: Statement, known: np.ndarray | None = None) -> dict:
    """Fold one statement in; returns what was decided (seq, decision, action, target, memory, reasons)."""
    found, structural, truncated = candidates_of(store, s.fact, s.vector, known)
    past = {m.id for m, _ in found if m.id in store.past}
    decision, target, reasons = assess(s.fact, s.content, found, past)
    looked = ["structural_candidates_truncated"] * truncated
    if target is not None and target.id in structural:
        looked.append(f"structural_candidate:{target.id}")
    memory, more = apply(store, s, decision, target, found)
    reasons = [*reasons, *looked, *more, *_fulfil(store, s, memory, found, past)]
    return {"seq": s.seq, "decision": decision, "action": ACTIONS[decision], "target_id": target.id if target else None, "memory_id": memory.id, "reason_codes": reasons}


OUTPUT = "tenant string, record string, seq bigint, decision string, action string, target_id bigint, memory_id bigint, reason_codes array<string>, content string, category string, state string, importance double, confidence double, access_count int, version int, is_contradicted boolean, contradicted_by_id bigint, relationship_type string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def with_facts(statements: DataFrame) -> DataFrame:
    """Statements (tenant, seq, content, category, optional embedding) with their fact; blank ones are left out."""
    s = statements if "embedding" in statements.columns else statements.withColumn("embedding", F.lit(None).cast("array<float>"))
    s = s.where("tenant IS NOT NULL AND seq IS NOT NULL AND length(trim(content)) > 0")
    return s.select("tenant", "seq", "content", "category", "embedding").withColumn("fact", extraction.facts(F.col("content")))


def fold(store: Store, rows: pd.DataFrame) -> list[dict]:
    """Decisions for the rows in the order of seq; ``store`` is changed."""
    todo = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        fact = None if r.fact is None else dict(r.fact.asDict() if hasattr(r.fact, "asDict") else r.fact)
        fact = fact if fact and fact.get("entity") is not None else None
        vector = None if r.embedding is None or len(r.embedding) == 0 else np.asarray(r.embedding, np.float64)
        todo.append(Statement(int(r.seq), r.content, r.category, fact, vector))
    out = []
    for lo in range(0, len(todo), CHUNK):
        part = todo[lo : lo + CHUNK]
        have = [i for i, s in enumerate(part) if s.vector is not None]
        products = dict(zip(have, np.stack([_unit(part[i].vector) for i in have]) @ store.units[: store.used].T, strict=True)) if have and store.used else {}
        out += [step(store, s, products.get(i)) for i, s in enumerate(part)]
    return out


def _records(tenant: str, store: Store, decisions: list[dict]) -> Iterator[dict]:
    yield from ({"tenant": tenant, "record": "decision", **d} for d in decisions)
    for m in store.memories.values():
        yield {"tenant": tenant, "record": "memory", "memory_id": m.id, **{k: getattr(m, k) for k in ("content", "category", "state", "importance", "confidence", "access_count", "version", "is_contradicted", "contradicted_by_id")}}
    yield from ({"tenant": tenant, "record": "link", "memory_id": s, "target_id": t, "relationship_type": k} for s, t, k in store.all_links())


def _tenant(rows: pd.DataFrame) -> pd.DataFrame:
    store = Store()
    decisions = fold(store, rows)
    return pd.DataFrame(list(_records(rows["tenant"].iloc[0], store, decisions)), columns=_COLUMNS).astype(object).where(lambda x: x.notna(), None)


def evolve(statements: DataFrame) -> DataFrame:
    """One frame of records: decisions (one a statement), final memories and lineage links of each tenant."""
    return with_facts(statements).groupBy("tenant").applyInPandas(_tenant, OUTPUT)


def decisions(records: DataFrame) -> DataFrame:
    return records.where("record = 'decision'").select("tenant", "seq", "decision", "action", "target_id", "memory_id", "reason_codes")


def memories(records: DataFrame) -> DataFrame:
    return records.where("record = 'memory'").select("tenant", F.col("memory_id").alias("id"), "content", "category", "state", "importance", "confidence", "access_count", "version", "is_contradicted", "contradicted_by_id")


def links(records: DataFrame) -> DataFrame:
    return records.where("record = 'link'").select("tenant", F.col("memory_id").alias("source_memory_id"), F.col("target_id").alias("target_memory_id"), "relationship_type")


# What a fold leaves beside memories and lineage is derived from its decisions, as joins over all statements.

PROVENANCE = {"source_type": "string", "conversation_id": "string", "message_id": "string", "observed_at": "timestamp"}


def evidence(statements: DataFrame, decided: DataFrame, version: str) -> DataFrame:
    """One row for each statement: the memory that it made or changed, where it came from, what was decided and why.

    ``statements`` may have source_type (api where it is missing), conversation_id, message_id and observed_at.
    """
    extra = [F.col(c) if c in statements.columns else F.lit(None).cast(t).alias(c) for c, t in PROVENANCE.items()]
    s = statements.where("tenant IS NOT NULL AND seq IS NOT NULL").select("tenant", "seq", F.col("content").alias("raw_text"), *extra)
    confidence = extraction.facts(F.col("raw_text"))["confidence"]
    j = decided.join(s, ["tenant", "seq"]).withColumn("source_type", F.coalesce("source_type", F.lit("api")))
    return j.select("tenant", "seq", "memory_id", *PROVENANCE, F.lit("deterministic_nlp").alias("extraction_method"), F.lit(version).alias("extractor_version"), confidence.alias("confidence"), "raw_text", F.lower("decision").alias("decision"), "reason_codes")


def graph_changes(statements: DataFrame, decided: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, links, edges) that the statements add to their tenant's graph.

    entities: (tenant, name, entity_type), the type of the first statement that names it; links: (tenant,
    memory_id, name, role), the role of the first; edges: (tenant, source, relationship, target,
    memory_id), each once and none to itself. ``aliases`` (alias_normalized, name) stand for their entity.
    """
    s = statements.where("tenant IS NOT NULL AND seq IS NOT NULL").select("tenant", "seq", extraction.related(F.col("content")).alias("g"))
    s = materialize(decided.select("tenant", "seq", "memory_id").join(s, ["tenant", "seq"]))

    def real(df: DataFrame, column: str) -> DataFrame:
        if aliases is None:
            return df
        a = aliases.select(F.col("alias_normalized").alias(column), F.col("name").alias("__name"))
        return df.join(a, column, "left").withColumn(column, F.coalesce("__name", column)).drop("__name")

    named = real(s.select("tenant", "seq", "memory_id", F.posexplode("g.links").alias("at", "l")).select("tenant", "seq", "memory_id", "at", F.col("l.name").alias("name"), "l.label", "l.role"), "name")
    first = F.struct("seq", "at")
    kind = F.when(F.col("label") == extraction.USER, "USER").otherwise(F.col("label"))
    entities = named.groupBy("tenant", "name").agg(F.min_by(kind, first).alias("entity_type"))
    links = named.groupBy("tenant", "memory_id", "name").agg(F.min_by("role", first).alias("role"))
    e = s.select("tenant", "memory_id", F.explode("g.edges").alias("e")).select("tenant", "memory_id", "e.source", "e.relationship", "e.target")
    edges = real(real(e, "source"), "target").where("source <> target").select("tenant", "source", "relationship", "target", "memory_id").distinct()
    return entities, links, edges
