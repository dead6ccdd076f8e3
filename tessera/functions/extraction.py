"""Facts from short statements by a closed grammar of subject, verb group and object.

One pass over the words of the main clause: a subject phrase, a group of auxiliaries and adverbs around
the main verb, then objects cut at prepositions. There is no statistical parser here; open-domain
parity with one is not claimed. ``facts`` is the vectorised form for a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

# Words of the grammar.
USER_WORDS = {"i", "me", "my", "myself"}
PRONOUNS = {"we", "he", "she", "they", "it", "you", "that", "this", "these", "those", "them", "him", "her", "us"}
RELATION_NOUNS = ("brother", "sister", "mother", "father", "friend", "colleague", "wife", "husband", "son", "daughter", "boss", "manager", "partner")
ABSTRACT = {"language", "concept", "framework", "library", "code", "script", "method", "syntax", "service", "app", "software", "tool", "technique", "process", "strategy", "algorithm"}
VERB_ATTRIBUTES = {
    "live": ("residence", "LOCATION"),
    "reside": ("residence", "LOCATION"),
    "stay": ("residence", "LOCATION"),
    "move": ("residence", "LOCATION"),
    "work": ("employer", "EMPLOYMENT"),
    "employed": ("employer", "EMPLOYMENT"),
    "transfer": ("employer", "EMPLOYMENT"),
    "prefer": ("preference", "PREFERENCE"),
    "like": ("preference", "PREFERENCE"),
    "love": ("preference", "PREFERENCE"),
    "enjoy": ("preference", "PREFERENCE"),
    "learn": ("learning_topic", "LEARNING"),
    "study": ("learning_topic", "LEARNING"),
    "master": ("learning_topic", "LEARNING"),
    "own": ("device", "DEVICE"),
    "play": ("activity", "ACTIVITY"),
    "practice": ("activity", "ACTIVITY"),
}
NOUN_ATTRIBUTES = {
    "location": ("residence", "LOCATION"),
    "city": ("residence", "LOCATION"),
    "residence": ("residence", "LOCATION"),
    "employer": ("employer", "EMPLOYMENT"),
    "company": ("employer", "EMPLOYMENT"),
    "workplace": ("employer", "EMPLOYMENT"),
    "preference": ("preference", "PREFERENCE"),
    "drink": ("favorite_drink", "PREFERENCE"),
    "food": ("preference", "PREFERENCE"),
    "language": ("preference", "PREFERENCE"),
    "topic": ("learning_topic", "LEARNING"),
    "name": ("name", "PROFILE"),
    "age": ("age", "PROFILE"),
}
INTENTIONS = {"plan", "intend", "expect", "aim", "schedule", "prepare"}
PLACEHOLDERS = {"this", "that", "it", "something", "anything"}
MISSING, NO_ATTRIBUTE = "unknown", "general"
BE = {"am", "is", "are", "was", "were", "be", "been", "being", "'m", "'s", "'re"}
HELPERS = {"do", "does", "did", "will", "would", "have", "has", "had", "can", "could", "should", "may", "might", "not", "n't", "never", "no", "to"}
TIMES = {"day", "week", "weekend", "month", "quarter", "year", "years", "months", "weeks", "days", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}
CLAUSE_WORDS = {"or", "but", "because", "while", "who", "which", "when", "where", "if", "although", "though"}
ADVERBS = {"now", "soon", "currently", "also", "really", "often", "usually", "always", "primarily", "mainly", "mostly", "still", "just", "already", "currently", "recently", "longer", "formerly", "previously", "anymore", "today", "tomorrow", "tonight", "then", "back", "sometimes", "once"}
PREPOSITIONS = {"in", "at", "to", "for", "on", "with", "from", "near", "by", "of", "as", "into", "about", "around", "during", "since", "until", "after", "before", "over", "under", "through"}
DETERMINERS = {"a", "an", "the", "my", "our", "your", "his", "her", "their", "its", "this", "that", "these", "those", "some", "any", "every", "each"}
QUESTION_WORDS = {"what", "where", "who", "when", "which", "how", "why"}
IRREGULAR = {"went": "go", "bought": "buy", "ate": "eat", "drank": "drink", "ran": "run", "drove": "drive", "met": "meet", "had": "have", "has": "have", "did": "do", "saw": "see", "made": "make", "took": "take", "left": "leave", "knew": "know", "wrote": "write", "spent": "spend", "said": "say", "told": "tell"}
KNOWN_VERBS = {*(VERB_ATTRIBUTES.keys() - {"employed"}), *INTENTIONS, *IRREGULAR.values(), "use", "visit", "eat", "drink", "drive", "read", "want", "need", "travel", "relocate", "change", "exercise", "turn", "pick", "collect", "run", "thank", "remind", "sound"} - {"do"}
DEICTIC = {"there", "here"}
#: Verb to relation of the entity graph; the first in the list that the statement has wins.
RELATIONS = (("like", "likes"), ("love", "likes"), ("enjoy", "likes"), ("prefer", "prefers"), ("study", "studies"), ("learn", "studies"), ("work", "works_at"), ("live", "lives_in"), ("own", "owns"), ("use", "uses"))
MENTIONS, USER, CONCEPT = "mentions", "user", "CONCEPT"
NO_ENTITY = {"what", "who", "whom", "which", "where", "when", "why", "how", "something", "anything", "everything", "nothing", "thing", "things", "someone", "anyone", "everyone", "one"}
ABBREVIATED = {"'ve": "have", "'ll": "will", "'d": "would"}


@dataclass
class Fact:
    """One fact of a statement; ``attribute`` is ``general`` where none could be told."""

    entity: str
    attribute: str
    value: str
    fact_type: str = "OTHER"
    temporal_state: str = "CURRENT"
    relationship_to_user: str | None = None
    is_negated: bool = False
    is_placeholder: bool = False
    is_question: bool = False
    confidence: float = 0.35


def _lemma(word: str) -> tuple[str, str] | None:
    """(base form, tense) of a known verb: base, s, past or ing."""
    w = word.lower()
    if w in KNOWN_VERBS:
        return w, "base"
    if w in IRREGULAR:
        return IRREGULAR[w], "s" if w == "has" else "past"
    for end, tense in (("ies", "s"), ("es", "s"), ("s", "s"), ("ied", "past"), ("ed", "past"), ("ing", "ing")):
        if w.endswith(end):
            stem = w[: -len(end)]
            for base in (stem, stem + "e", stem + "y", stem[:-1] if stem[-1:] == stem[-2:-1] else stem):
                if base in KNOWN_VERBS:
                    return base, tense
    return None


def _cue(text: str, cues: tuple[str, ...]) -> bool:
    return re.search(X.cue_pattern(cues), text) is not None


def _words(clause: str) -> list[str]:
    clause = re.sub(r"(?i)n't\b", " not", clause)
    clause = re.sub(r"(?i)('m|'re|'ve|'ll|'d)\b", r" \1", clause)
    found = re.findall(r"'?[\w][\w'’.+#&-]*|[,;:?!.]", clause)
    return [ABBREVIATED.get(w.lower(), w.rstrip(".") if len(w) > 2 else w) for w in found]


def _phrase(words: list[str]) -> str:
    """A noun phrase without determiners."""
    kept = [w for w in words if (w.lower() not in DETERMINERS or len(words) == 1) and w.lower() not in ADVERBS | DEICTIC and re.match(r"\w", w)]
    if kept and kept[0].lower() in PRONOUNS:
        kept = kept[:1]
    return " ".join(kept).strip(".,!?\"'")


def _split_subject(words: list[str]) -> tuple[list[str], list[str]]:
    """The subject's words and the rest, which begins with the verb group."""
    if not words:
        return [], []
    low = [w.lower() for w in words]
    if low[0] in USER_WORDS - {"my"} or (low[0] in PRONOUNS and len(words) > 1):
        return words[:1], words[1:]
    if len(words) > 1 and _lemma(low[0]) and low[0] in KNOWN_VERBS and (low[1] in PRONOUNS or low[1] in USER_WORDS):
        return [], words  # an imperative
    noun = lambda i: low[i] in NOUN_ATTRIBUTES and i + 1 < len(low) and low[i + 1] in BE
    at = next((i for i, w in enumerate(low) if i and not noun(i) and (w in BE or w in HELPERS or _lemma(w))), None)
    if at is None:  # an unknown verb: behind a run of names, or in third person
        at = next((i for i, w in enumerate(words) if i and w[0].islower() and low[0] not in DETERMINERS), None)
        at = at or next((i for i, w in enumerate(low) if i > 1 and re.search(r"(s|ed)$", w)), len(words))
    return words[:at], words[at:]


def extract_fact(text: str | None) -> Fact | None:
    """The fact that a statement states, or None for empty text and text without verb or value."""
    raw = (text or "").strip()
    if not raw:
        return None
    question = raw.endswith("?")
    clause = re.sub(r"(?i)^(someone|somebody|people|they|he|she)\s+(said|says|say|told me|claims?|mentioned)\s+(that\s+)?", "", raw)
    clause = re.sub(r"(?i)^(before|after|when|while|since|as of today|right now|at the moment)\b[^,]*,\s*", "", clause)
    clause = re.sub(r"(?i)^(right now|as of today|currently|now|today|these days)\s+", "", clause)
    words = [w for w in _words(clause) if w not in {".", "!", "?"}]
    low_all = {w.lower() for w in _words(raw)}
    if question and words and words[0].lower() in QUESTION_WORDS:
        words = _statement_order(words)
    subject, rest = _split_subject(words)
    own = any(w.lower() == "my" for w in words)
    entity, relation = _entity(subject, own, rest)
    placeholder_subject = len(subject) == 1 and subject[0].lower() in PRONOUNS

    # verb group: helpers and adverbs up to the main verb
    i, verb, tense, passive_be, intended, used_to = 0, None, "base", False, False, False
    past_helper = False
    while i < len(rest):
        w = rest[i].lower()
        known = _lemma(w)
        nxt = rest[i + 1].lower() if i + 1 < len(rest) else ""
        if w == "used" and nxt == "to":
            used_to, i = True, i + 2
        elif w == "going" and nxt == "to":
            i += 2
        elif known and known[0] in INTENTIONS and nxt == "to":
            intended, i = True, i + 2
        elif w in HELPERS and any(_lemma(x) for x in rest[i + 1 :]):
            past_helper, i = past_helper or w == "did", i + 1
        elif known and w not in BE:
            verb, tense = known
            i += 1
            break
        elif w in BE:
            passive_be, past_helper, i = True, past_helper or w in {"was", "were"}, i + 1
        elif w in HELPERS or w in ADVERBS or w == ",":
            past_helper, i = past_helper or w == "did", i + 1
        else:
            if not passive_be and subject and verb is None and i + 1 <= len(rest):
                verb, tense = (re.sub(r"(?<=\w{3})(ed|s)$", "", w), "past" if w.endswith("ed") else "base")
                i += 1
            break
    if verb is None and passive_be:
        verb, tense = "be", "past" if past_helper else "base"
    after = _cut(rest[i:])
    negated = bool(low_all & {"not", "no", "never", "anymore"})

    attribute, kind = _attribute(verb, subject, after, entity)
    value, by_preposition = _value(verb, after, entity, subject)
    if not value or value.lower() in PLACEHOLDERS:
        if attribute is None:
            return None
        return Fact(entity, attribute, value or MISSING, kind, is_placeholder=True, is_question=question)
    low = raw.lower()
    state = "CURRENT"
    if _cue(low, X.PAST_CUES) or used_to or tense == "past":
        state = "CURRENT" if _cue(low, X.TRANSITION_CUES) else "HISTORICAL"
        if intended and state == "CURRENT" and not _cue(low, X.PAST_CUES) and tense != "past":
            state = "FUTURE"
    elif intended or _cue(low, X.FUTURE_CUES):
        state = "FUTURE"
    if negated and _cue(low, X.NEGATION_CUES):
        state = "HISTORICAL"
    confidence = 0.60 + (0.25 if attribute else 0.0) + (0.10 if " " in value or value[0].isupper() else 0.0)
    return Fact(entity, attribute or NO_ATTRIBUTE, value, kind, state, relation, negated, placeholder_subject or value.lower() in PRONOUNS, question, round(min(confidence, 0.95), 2))


def _cut(after: list[str]) -> list[str]:
    """The words behind the verb up to another clause or a stretch of time; ``likes to drink x`` is about x."""
    low = [w.lower() for w in after]
    if len(low) > 2 and low[0] == "to" and _lemma(low[1]):
        return _cut(after[2:])
    for i, w in enumerate(low):
        nxt = low[i + 1] if i + 1 < len(low) else ""
        joined = w == "and" and (_lemma(nxt) or nxt in BE | HELPERS | USER_WORDS | PRONOUNS)
        time = (w in {"next", "last"} and nxt in TIMES) or nxt == "ago"
        if i and (w in CLAUSE_WORDS or joined or time):
            return after[: i - 1] if time and low[i - 1] in {"a", "some", "many", "several", "few", "two", "three"} else after[:i]
    return after


def _statement_order(words: list[str]) -> list[str]:
    """``What city do I live in`` as ``I live in city``: the asked phrase goes behind the verb."""
    low = [w.lower() for w in words]
    at = next((i for i, w in enumerate(low) if w in {"do", "does", "did", "am", "is", "are", "was", "were", "will"}), None)
    if at is None:
        return words[1:]
    end = at + 2
    while end < len(words) and words[end][0].isupper() and words[at + 1][0].isupper():
        end += 1
    return [*words[at + 1 : end], words[at], *words[end:], *words[1:at]]


def _entity(subject: list[str], own: bool, rest: list[str]) -> tuple[str, str | None]:
    """The entity that the fact is about, and its relation to the user."""
    low = [w.lower() for w in subject]
    relation = next((n for n in RELATION_NOUNS if n in low and own), None)
    names = [w for w in subject if w == "," or (w[0].isupper() and w.lower() not in USER_WORDS | PRONOUNS | DETERMINERS)]
    if any(w != "," for w in names) and (low[0] in DETERMINERS or len(names) == len(subject)):
        return " ".join(names).replace(" ,", ",").strip(" ,"), relation
    if not subject or low[-1] in USER_WORDS:
        return "user", relation
    if own and low and low[0] == "my":
        if low[-1] in RELATION_NOUNS:
            return subject[-1], relation
        return ("user" if rest and rest[0].lower() in BE else subject[-1]), relation
    return subject[-1], relation


def _attribute(verb: str | None, subject: list[str], after: list[str], entity: str) -> tuple[str | None, str]:
    if verb is None:
        return None, "OTHER"
    if verb == "be":
        nouns = [w.lower() for w in subject if w.lower() not in DETERMINERS | USER_WORDS | PRONOUNS and w.islower()]
        nouns = nouns or [w.lower() for w in after if w.isalpha() and w.islower() and w not in DETERMINERS | PREPOSITIONS | ADVERBS][-1:]
        return NOUN_ATTRIBUTES.get(nouns[-1], (nouns[-1], "PROFILE")) if nouns else (None, "OTHER")
    if verb == "use":
        direct = _direct(after)
        fixed = any(w.lower() in DETERMINERS for w in direct)
        head = direct[-1].lower() if direct else ""
        bare_name = bool(direct) and direct[-1][0].isupper() and not fixed
        concrete = direct and head not in ABSTRACT and not bare_name
        return ("device", "DEVICE") if concrete and (fixed or not {w.lower() for w in after} & {"for", "to"}) else ("tool", "OTHER")
    if verb == "work":
        preps = [w.lower() for w in after if w.lower() in PREPOSITIONS]
        if preps and not {"at", "for"} & set(preps[:2]):
            return f"work_{preps[0]}", "OTHER"
    return VERB_ATTRIBUTES.get(verb, (verb, "OTHER"))


def _direct(after: list[str]) -> list[str]:
    """Words up to the first preposition."""
    out = []
    for w in after:
        if w.lower() in PREPOSITIONS or w in {",", ";", ":"}:
            break
        out.append(w)
    return out


def _value(verb: str | None, after: list[str], entity: str, subject: list[str]) -> tuple[str, bool]:
    """The direct object, else the last prepositional object."""
    direct = _phrase(_direct(after))
    if direct and direct.lower() not in USER_WORDS and direct.lower() != entity.lower():
        return direct, False
    parts: list[list[str]] = []
    for w in after:
        if w.lower() in PREPOSITIONS:
            parts.append([])
        elif w in {",", ";", ":"}:
            break
        elif parts:
            parts[-1].append(w)
    objects = [p for p in (_phrase(x) for x in parts) if p and p.lower() not in USER_WORDS and p.lower() != entity.lower()]
    if verb in {"live", "work", "move", "stay", "reside", "transfer"} and objects:
        return objects[0], True
    return (objects[-1], True) if objects else ("", True)


FACT_DDL = "struct<entity:string,attribute:string,value:string,fact_type:string,temporal_state:string,relationship_to_user:string,is_negated:boolean,is_placeholder:boolean,is_question:boolean,confidence:double>"


def facts(content: Column) -> Column:
    """Nullable fact struct of a text column, in Arrow batches."""

    @F.pandas_udf(FACT_DDL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = list(Fact.__dataclass_fields__)
        for s in batches:
            got = [extract_fact(t) for t in s]
            yield pd.DataFrame([asdict(f) if f else dict.fromkeys(names) for f in got], columns=names)

    return run(content)


def named(text: str | None, fact: Fact | None = None) -> list[tuple[str, str]]:
    """(key, label) of names and concepts in a statement, each key once, names first.

    A name is a run of capitalised words; a concept is the fact's value or another object of the sentence.
    """
    words = _words((text or "").strip())
    runs: list[list[str]] = [[]]
    for i, w in enumerate(words):
        if w[0].isupper() and w.lower() not in USER_WORDS | PRONOUNS | DETERMINERS | NO_ENTITY and not (i == 0 and _opens(words)):
            runs[-1].append(w)
        elif runs[-1]:
            runs.append([])
    found = [(" ".join(r), "NAME") for r in runs if r]
    fact = fact or extract_fact(text)
    if fact and not fact.is_placeholder:
        found.append((fact.value, CONCEPT))
    part: list[str] = []
    for w in [*words[1:], "."]:
        low = w.lower()
        if low in PREPOSITIONS or low in CLAUSE_WORDS | {"and"} or not re.match(r"\w", w) or _lemma(low) or low in BE | HELPERS:
            name = _phrase(part) if part else ""
            if name and name[0].islower() and not any(x[0].isupper() for x in part) and name.lower() not in USER_WORDS | PRONOUNS | TIMES:
                found.append((name, CONCEPT))
            part = []
        elif not (w[0].isupper() and not part):
            part.append(w)
    out: dict[str, str] = {}
    for k, label in found:
        key = entity_key(k)
        if key and key not in NO_ENTITY | USER_WORDS | PRONOUNS and key not in out:
            out[key] = label
    return list(out.items())


def _opens(words: list[str]) -> bool:
    """Whether the first word is capital only because it begins the sentence."""
    first = words[0].lower()
    return first in PREPOSITIONS | QUESTION_WORDS | HELPERS | BE | ADVERBS | CLAUSE_WORDS or _lemma(first) is not None or not (len(words) > 1 and (words[1][0].isupper() or _lemma(words[1].lower()) or words[1].lower() in BE | HELPERS))


def entity_key(name: str) -> str:
    """Lower case, single spaces, no edge punctuation, leading determiners or final 's."""
    words = [w.strip(X.EDGE_PUNCTUATION) for w in name.lower().split()]
    words = [w for w in words if w]
    while words and words[0] in X.DETERMINERS:
        words = words[1:]
    return re.sub(r"'s$", "", " ".join(words))


def entities(text: str | None) -> list[tuple[str, str]]:
    """(key, label) of the entities of a text; see :func:`named`."""
    return named(text)


def relation_of(text: str | None, fact: Fact | None) -> str:
    """How the subject relates to the fact's value: ``work_with`` and the like, else by the statement's verbs."""
    if fact and fact.attribute.startswith("work_"):
        return fact.attribute
    verbs = {v[0] for w in _words(text or "") if (v := _lemma(w))}
    return next((r for verb, r in RELATIONS if verb in verbs), MENTIONS)


def relationships(text: str | None) -> tuple[str, list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(subject, links, edges) of a statement: links are (key, label, role), edges (source, relation, target).

    The fact's subject is never put in the user's place; the user is tied to a subject that the statement calls
    a relation of theirs. Only the fact's value gets the statement's relation, other entities are mentioned.
    """
    fact = extract_fact(text)
    subject = entity_key(fact.entity) if fact and fact.entity.lower() != USER else USER
    value, relation = entity_key(fact.value) if fact else "", relation_of(text, fact)
    found = named(text, fact)
    labels = dict(found)
    links = [(subject, USER if subject == USER else labels.get(subject, CONCEPT), "subject")] if subject else []
    links += [(k, label, "value" if k == value else "mention") for k, label in found if k != subject]
    edges = [(USER, f"{fact.relationship_to_user}_of", subject)] if fact and fact.relationship_to_user and subject != USER else []
    edges += [(subject, relation if k == value else MENTIONS, k) for k, _ in found if subject and k not in (subject, USER)]
    return subject, links, edges


RELATED_DDL = "struct<subject:string,links:array<struct<name:string,label:string,role:string>>,edges:array<struct<source:string,relationship:string,target:string>>>"


def related(content: Column) -> Column:
    """Subject, links and edges of a text column (see :func:`relationships`), in Arrow batches."""

    @F.pandas_udf(RELATED_DDL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                subject, links, edges = relationships(t)
                rows.append((subject, [dict(zip(("name", "label", "role"), x, strict=True)) for x in links], [dict(zip(("source", "relationship", "target"), x, strict=True)) for x in edges]))
            yield pd.DataFrame(rows, columns=["subject", "links", "edges"])

    return run(content)


INTENT_DDL = "struct<entity:string,attribute:string,names:array<string>>"
#: Attributes that tell nothing about what a question asks for.
UNINFORMATIVE = {NO_ATTRIBUTE, "be", "do"}


def asked(query: Column) -> Column:
    """What a question is about, read from its text: entity, attribute (null if none is told) and entity names."""

    @F.pandas_udf(INTENT_DDL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                f = extract_fact(t)
                rows.append((f.entity if f else None, f.attribute if f and f.attribute.lower() not in UNINFORMATIVE else None, [k for k, _ in named(t, f)]))
            yield pd.DataFrame(rows, columns=["entity", "attribute", "names"])

    return run(query)
