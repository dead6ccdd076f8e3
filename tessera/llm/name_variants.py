"""Variant spellings of person and organisation names, linked by canonical rewritings.

Every name is rewritten by rules into canonical identities: accents, titles, degrees, pronouns and
notes are dropped, ``Last, First`` and swapped order are turned, familiar forms become the given names
they stand for, legal forms and trades are written out. An identity is

* full: a given name (or trade and legal form) and a surname (or company name), or
* weak: a part is missing or stands for several (an initial, a familiar form of two names, a company
  without its trade or legal form).

Typing errors are rewritings too: a form is exploded into itself and itself without one character, and
two forms within one edit always share one of these. Forms are hashed and equi-joined; the pairs are
then compared exactly. Full identities link to each other. A weak identity is scored by the rarity of
its rewriting, one over the number of entities that it can stand for (at the least edit), and links where
that is ``least_rarity`` or more. Linked identities are closed into entities by connected components.

Two names that are both frequent as given names are different people even at one edit, as are two
middle initials that differ, and companies of one name in different trades.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import connected_components
from tessera.scale import discard, materialize

# Titles, degrees and notes that are no part of a name.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "eng", "rev", "hon", "capt", "col", "judge"}
DEGREES = {"mba", "phd", "md", "ma", "msc", "bsc", "ba", "esq", "jd", "cpa", "dds", "rn"}
NOTES = {"hq", "main", "office", "group", "the", "of", "and", "work", "home", "private"}
# Legal forms and their short forms.
LEGAL = {
    "company": ("co",),
    "brothers": ("bros",),
    "associates": ("assoc", "assocs"),
    "partners": ("ptnrs", "prtnrs"),
    "corporation": ("corp",),
    "incorporated": ("inc",),
    "holdings": ("hldgs", "hldg"),
    "limited": ("ltd",),
    "cooperative": ("coop",),
    "llc": (),
    "plc": (),
    "gmbh": (),
    "ag": (),
}
# Short forms of trades that are no subsequence of the word or of several.
TRADE_SHORT = {"comms": "communications", "labs": "laboratories", "pkg": "packaging", "ins": "insurance"}
#: Share of the company names from which a word behind the first is a trade (at most 1 / share words).
TRADE_SHARE = 0.01
#: Share of the person names from which a first word is a given name (at most 1 / share words).
GIVEN_SHARE = 0.0008
#: Letters that no decomposition turns into a base letter.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})

#: Parts of the forms that are joined one after the other, so that the shuffle holds one of them.
SLICES = 4

_LEGAL_FORM = {s: k for k, v in LEGAL.items() for s in (k, *v)}
_TAIL = re.compile(r"\s*\(.*$|\s+-+\s+.*$|,\s*(main office|head office|hq|headquarters)\s*$")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    low = unicodedata.normalize("NFKD", text.lower().translate(PLAIN))
    return "".join(c for c in low if not unicodedata.combining(c))


def _tokens(text: str) -> list[str]:
    """Words without possessive, hyphens and inner dots."""
    text = re.sub(r"['’]s\b", "", text)
    return [w for t in text.split() if (w := "".join(_WORD.findall(t)))]


def one_edit(a: str, b: str) -> int | None:
    """0 if equal, 1 if one insertion, deletion, substitution or swap of neighbours apart, else None."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return None
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return 1 if a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]) else None
    short, long = sorted((a, b), key=len)
    return 1 if short[i:] == long[i + 1 :] else None


def deletions(s: str) -> set[str]:
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def trade_of(word: str, trades: set[str]) -> str | None:
    """The trade a word names, shortens (its letters in order, the first one equal) or mistypes."""
    if word in trades:
        return word
    if word in TRADE_SHORT and TRADE_SHORT[word] in trades:
        return TRADE_SHORT[word]
    fits = [t for t in trades if word[0] == t[0] and 2 <= len(word) < len(t) and _inside(word, t)]
    if len(fits) > 1:
        fits = [t for t in fits if t.startswith(word)] or fits
    if not fits and len(word) >= 4:
        fits = [t for t in trades if one_edit(word, t)]
    return fits[0] if len(fits) == 1 else None


def _inside(word: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in word)


def corrected(word: str, near: dict[str, set[str]]) -> str | None:
    """The one known given name within one edit of ``word``; ``near`` has the names by their deletions."""
    fits = {g for x in deletions(word) for g in near.get(x, ()) if one_edit(word, g)}
    return fits.pop() if len(fits) == 1 and len(word) > 3 else None


def person_identities(name: str, given: set[str], forms: dict[str, set[str]], near: dict[str, set[str]]) -> list[tuple[str, str, str, bool]]:
    """(given name or initial, surname, middle initials, weak) for each way to read the name."""
    text = _TAIL.sub("", plain(name)).strip(" ,;")
    parts = [_tokens(p) for p in text.split(",")]
    parts = [[t for t in p if t not in TITLES and t not in DEGREES] for p in parts]
    parts = [p for p in parts if p]
    if not parts or sum(map(len, parts)) == 1:
        return []
    known = lambda t: t in given or t in forms or corrected(t, near) is not None
    words = [t for p in parts for t in p if len(t) > 1]
    initials = [t for p in parts for t in p if len(t) == 1]
    if len(parts) > 1 and any(len(t) > 1 for t in parts[0]):
        surname = [t for t in parts[0] if len(t) > 1]
        rest = [t for t in parts[1] if len(t) > 1]
        orders = [(rest[:1] or initials[:1], surname + rest[1:])]
    elif len(words) == 1 or (len(words) > 1 and len(parts[0][0]) == 1 and not any(map(known, words))):
        orders = [(initials[:1], words)]
    elif known(words[0]):
        orders = [(words[:1], words[1:])]
    elif known(words[-1]):
        orders = [(words[-1:], words[:-1])]
    else:
        orders = [(words[:1], words[1:]), (words[-1:], words[:-1])]
    out = []
    for first, rest in orders:
        if not first or not rest:
            continue
        g, surname = first[0], "".join(rest)
        middle = "".join(sorted(initials[1:] if len(g) == 1 else initials))
        if len(g) == 1:
            out.append((g, surname, middle, True))
            continue
        full = [*([g] if g in given else []), *sorted(forms.get(g, ()))]
        if not full and (better := corrected(g, near)):
            out += [(better, surname, middle, False), (g, surname, middle, False)]
        else:
            out += [(f, surname, middle, len(full) > 1) for f in full or [g]]
    return out


def organisation_identity(name: str, trades: set[str]) -> list[tuple[str, str, str, bool]]:
    """(trade, company name, legal form, weak) of a company; a missing part is empty."""
    text = re.sub(r"\bco-op\b", "coop", _TAIL.sub("", plain(name)))
    text = re.sub(r"\s*&\s*co\b\.?", " ", text)
    words = [w for w in _tokens(text.replace(",", " ")) if w not in NOTES]
    sure = [_LEGAL_FORM.get(w) or (w if w in trades else None) for w in words]
    trade = legal = ""
    rest = []
    for k, w in enumerate(words):
        led = bool(rest) or any(s is None for s in sure[k + 1 :])  # another word is left to be the name
        form = _LEGAL_FORM.get(w) or (next((f for f in LEGAL if len(w) > 5 and one_edit(w, f)), None) if rest else None)
        if form and led:
            legal = legal or form
        elif led and not trade and (rest or w in trades or len(w) < 5) and (t := trade_of(w, trades)):
            trade = t
        else:
            rest.append(w)
    company = "".join(rest)
    return [(trade, company, legal, not (trade and legal))] if company else []


IDENTITY = "id bigint, kind string, a string, b string, c string, weak boolean"


def _identities(given: set[str], forms: dict[str, set[str]], trades: set[str]):
    near: dict[str, set[str]] = {}
    for g in given:
        for x in deletions(g):
            near.setdefault(x, set()).add(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, kind, *names in batch.itertuples(index=False):
                read = set()
                for n in names:
                    if isinstance(n, str) and n.strip():
                        read.update(person_identities(n, given, forms, near) if kind == "PERSON" else organisation_identity(n, trades))
                out += [(i, kind, *r) for r in sorted(read)]
            yield pd.DataFrame(out, columns=["id", "kind", "a", "b", "c", "weak"])

    return run


def shortened(s: Column) -> Column:
    """A text and all it becomes by leaving out one character: texts within one edit always share one of these."""
    return F.array_distinct(F.concat(F.array(s), F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))))


def edits(a: Column, b: Column) -> Column:
    """0 if equal, 1 if one insertion, deletion, substitution or swap of neighbours apart, else null."""
    apart = F.levenshtein(a, b, 2)
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: a == F.concat(b.substr(F.lit(1), i - 1), b.substr(i + 1, F.lit(1)), b.substr(i, F.lit(1)), b.substr(i + 2, F.length(b))))
    return F.when(apart == 0, 0).when(apart == 1, 1).when((apart == 2) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped, 1)


def forms() -> Column:
    """array<struct<form, offered, wanted>> of an identity (kind, a, b, c, weak): what it offers to be found and looks for.

    Full identities offer what weak ones look for: a name by its initial, a company without its trade or
    legal form. Among each other they meet by their own forms.
    """
    kind, a, b, c, weak = (F.col(x) for x in ("kind", "a", "b", "c", "weak"))
    form = lambda prefix, texts, offered, wanted: F.transform(texts, lambda x: F.struct(F.xxhash64(F.concat(prefix, x)).alias("form"), offered.alias("offered"), wanted.alias("wanted")))
    yes, no = F.lit(True), F.lit(False)
    initial = F.concat(F.lit("I"), a.substr(1, 1), F.lit("|"))
    by_initial = weak & (F.length(a) == 1)
    person = F.concat(
        F.when(~by_initial, form(F.lit("P"), shortened(F.concat(a, b)), ~weak, yes)).otherwise(F.array().cast(FORMS)),
        F.when(~weak | by_initial, form(initial, shortened(b), ~weak, by_initial)).otherwise(F.array().cast(FORMS)),
    )
    names = shortened(b)
    whole = F.concat(F.lit("O"), a, F.lit("|"), c, F.lit("|"))
    bare = lambda prefix: form(prefix, names, yes, no)
    # what an organisation lacks may be empty in the full form as well: each form counts once
    organisation = F.concat(form(whole, names, ~weak, yes), F.when(~weak, F.concat(bare(F.concat(F.lit("O"), a, F.lit("||"))), bare(F.concat(F.lit("O|"), c, F.lit("|"))), bare(F.lit("O||")))).otherwise(F.array().cast(FORMS)))
    return F.when(kind == "PERSON", person).otherwise(organisation)


FORMS = "array<struct<form:bigint,offered:boolean,wanted:boolean>>"


def compared(given: list[str]) -> Column:
    """The number of edits between a candidate pair that may be one entity (x full or weak, y full), else null.

    ``given`` are words known as given names: two of them are different names even at one edit.
    """
    x, y = {c: F.col(f"x{c}") for c in "abc"}, {c: F.col(f"y{c}") for c in "abc"}
    named = edits(F.concat(x["a"], x["b"]), F.concat(y["a"], y["b"]))
    others = (x["a"] != y["a"]) & x["a"].isin(given) & y["a"].isin(given)
    person = F.when(F.col("xweak") & (F.length(x["a"]) == 1), F.when(x["a"] == y["a"].substr(1, 1), edits(x["b"], y["b"]))).when(~((named > 0) & others), named)
    middle = (x["c"] != "") & (y["c"] != "") & ~F.arrays_overlap(F.split(x["c"], ""), F.split(y["c"], ""))
    fits = ((x["a"] == "") | (x["a"] == y["a"])) & ((x["c"] == "") | (x["c"] == y["c"]))
    return F.when(F.col("kind") == "PERSON", F.when(~middle, person)).otherwise(F.when(fits, edits(x["b"], y["b"])))


def _met(distinct: DataFrame, k: int) -> DataFrame:
    """(x, y): the identities of which x looks for a form that y offers, by the forms of slice ``k``; full ones once."""
    own = F.filter(forms(), lambda f: F.pmod(f["form"], F.lit(SLICES)) == k)
    exploded = distinct.select("key", "weak", F.explode(own).alias("f")).select("f.*", "key", "weak")
    x, y = exploded.where("wanted").select("form", F.col("key").alias("x"), "weak"), exploded.where("offered").select("form", F.col("key").alias("y"))
    return x.join(y, "form").where("weak OR x < y").select("x", "y").distinct()


def _frequent(words: DataFrame, n: int, share: float, least: int) -> set[str]:
    """Words in at least ``share`` of ``n`` names: at most 1 / share of them, so they fit the driver."""
    return {r["w"] for r in words.groupBy("w").count().where(F.col("count") >= max(share * n, least)).collect()}


def name_variants(entities: DataFrame, name_forms: DataFrame, aliases: DataFrame | None = None, least_rarity: float = 1.0) -> DataFrame:
    """(id, entity): entity is the least id of the rows that name the same person or organisation.

    ``entities`` has id, normalized_name, display_name and entity_type; rows that are neither PERSON
    nor ORG, without id or without a readable name are entities of their own. Null names are skipped,
    repeated rows join their first, an empty table gives no row. ``aliases`` (entity_id,
    alias_normalized) are further spellings of a row. ``name_forms`` (given_name, short_form) is a
    dictionary of the language, gathered by the driver. A name that could stand for several entities joins
    none of them, unless ``least_rarity`` is lowered (0.5: the first of two).
    """
    e = entities.select(F.col("id").cast("bigint").alias("id"), F.upper(F.trim("entity_type")).alias("kind"), F.col("normalized_name").alias("n1"), F.col("display_name").alias("n2")).where("id IS NOT NULL AND kind IN ('PERSON', 'ORG')")
    names = e.select("id", "kind", F.explode(F.array_distinct(F.array(F.lower("n1"), F.lower("n2")))).alias("n"))
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("entity_id").cast("bigint").alias("id"), F.lower("alias_normalized").alias("n")).join(e.select("id", "kind"), "id"))
    names = names.where("n IS NOT NULL")
    forms_of: dict[str, set[str]] = {}
    for r in name_forms.where("given_name IS NOT NULL AND short_form IS NOT NULL").distinct().collect():
        forms_of.setdefault(plain(r["short_form"]), set()).add(plain(r["given_name"]))
    given = {g for s in forms_of.values() for g in s}
    words = F.split(F.trim(F.regexp_replace("n", r"[^\p{L}\p{M}\s-]+", " ")), r"\s+")
    counts = {r["kind"]: r["count"] for r in e.groupBy("kind").count().collect()}
    behind = names.where("kind = 'ORG'").select(F.explode(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))).alias("w"))
    trades = {w for w in _frequent(behind, counts.get("ORG", 0), TRADE_SHARE, 3) if plain(w) not in _LEGAL_FORM and w not in NOTES and len(w) >= 5}
    firsts = names.where("kind = 'PERSON' AND n RLIKE '^[^,. ]{3,} [^,]+$'").select(F.element_at(words, 1).alias("w"))
    given |= {plain(w) for w in _frequent(firsts, counts.get("PERSON", 0), GIVEN_SHARE, 3)} - set(forms_of)
    ids = names.mapInPandas(_identities(given, forms_of, trades), IDENTITY).distinct()
    ids = materialize(ids.withColumn("key", F.xxhash64("kind", "a", "b", "c", "weak")), free=True)
    distinct = materialize(ids.select("key", "kind", "a", "b", "c", "weak").distinct(), free=True)
    # only hashes are exploded and shuffled, by one in SLICES of the forms at a time; names join the distinct pairs that met
    slices = [materialize(_met(distinct, k), free=True) for k in range(SLICES)]
    met = reduce(DataFrame.unionByName, slices).distinct()
    named = lambda s: distinct.select(F.col("key").alias(s), F.col("kind").alias(f"{s}kind"), F.col("weak").alias(f"{s}weak"), *[F.col(c).alias(f"{s}{c}") for c in "abc"])
    both = met.join(named("x"), "x").join(named("y"), "y").where("xkind = ykind").withColumnRenamed("xkind", "kind")
    pairs = materialize(both.select("x", "y", "xweak", compared(sorted(given)).alias("edits")).where("edits IS NOT NULL"), free=True)
    discard(*slices)
    # entities of full identities: identities that link, and identities of one row
    same_row = ids.where("NOT weak").groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("x", "y")
    full = distinct.where("NOT weak").select(F.col("key").alias("x"), F.col("key").alias("y"))
    comp = connected_components(pairs.where("NOT xweak").select("x", "y").unionByName(same_row).unionByName(full), "x", "y")
    comp = comp.select(F.col("node").alias("y"), "component")
    # a weak identity is scored by its rarity: one over the number of entities among its nearest full identities;
    # ways to read one row (several given names of a familiar form) count together
    cand = pairs.where("xweak").join(comp, "y").groupBy("x", "component").agg(F.min("edits").alias("edits"))
    near = cand.join(cand.groupBy("x").agg(F.min("edits").alias("edits")), ["x", "edits"])
    weak = ids.where("weak").select("id", F.col("key").alias("x"))
    rarity = weak.join(near, "x").select("id", "component").distinct().groupBy("id").agg((1 / F.count(F.lit(1))).alias("rarity"), F.min("component").alias("component"))
    alone = weak.groupBy("id").agg(F.min("x").alias("own")).join(rarity, "id", "left")
    attached = alone.select("id", F.when(F.col("rarity") >= least_rarity, F.col("component")).when(F.col("rarity").isNull(), F.col("own")).alias("component"))
    known = ids.where("NOT weak").join(comp.withColumnRenamed("y", "key"), "key").groupBy("id").agg(F.min("component").alias("component"))
    placed = known.unionByName(attached.join(known.select("id"), "id", "left_anti")).where("component IS NOT NULL")
    placed = materialize(placed, free=True)
    least = placed.groupBy("component").agg(F.min("id").alias("entity"))
    linked = placed.join(least, "component").select("id", "entity")
    all_ids = entities.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    return all_ids.join(linked, "id", "left").select("id", F.coalesce("entity", "id").alias("entity"))


def variant_pairs(variants: DataFrame) -> DataFrame:
    """(a, b): every pair of rows of one entity, a < b."""
    v = variants.where("id <> entity")
    heads = v.select(F.col("entity").alias("a"), F.col("id").alias("b"))
    others = v.select("entity", F.col("id").alias("a")).join(v.select("entity", F.col("id").alias("b")), "entity").where("a < b").select("a", "b")
    return heads.unionByName(others)
