"""Labelled statements, questions and timelines; queries and tests share them.

Fixed values: all of this module.
"""

from __future__ import annotations

from dataclasses import dataclass

#: (text, entity, attribute, value, temporal state)
FACTS = (
    ("I live in Pune.", "user", "residence", "Pune", "CURRENT"),
    ("I used to live in Mumbai.", "user", "residence", "Mumbai", "HISTORICAL"),
    ("I lived in Delhi.", "user", "residence", "Delhi", "HISTORICAL"),
    ("I moved to Pune.", "user", "residence", "Pune", "CURRENT"),
    ("I will move to Bangalore.", "user", "residence", "Bangalore", "FUTURE"),
    ("I am planning to move to Bangalore.", "user", "residence", "Bangalore", "FUTURE"),
    ("I work at Google.", "user", "employer", "Google", "CURRENT"),
    ("I now work at BMW.", "user", "employer", "BMW", "CURRENT"),
    ("I worked at Infosys.", "user", "employer", "Infosys", "HISTORICAL"),
    ("I work with William.", "user", "work_with", "William", "CURRENT"),
    ("My friend Rahul works at Google.", "Rahul", "employer", "Google", "CURRENT"),
    ("Rahul Sharma works at BMW.", "Rahul Sharma", "employer", "BMW", "CURRENT"),
    ("I like coffee in the morning.", "user", "preference", "coffee", "CURRENT"),
    ("I prefer espresso.", "user", "preference", "espresso", "CURRENT"),
    ("I use my MacBook Air for development.", "user", "device", "MacBook Air", "CURRENT"),
    ("I use Python for work.", "user", "tool", "Python", "CURRENT"),
    ("I am learning FastAPI.", "user", "learning_topic", "FastAPI", "CURRENT"),
    ("My favorite drink is coffee.", "user", "favorite_drink", "coffee", "CURRENT"),
    ("I do not live in Mumbai anymore.", "user", "residence", "Mumbai", "HISTORICAL"),
    ("Before living in Mumbai, I lived in Pune.", "user", "residence", "Pune", "HISTORICAL"),
)


@dataclass(frozen=True)
class Timeline:
    """Statements in order with their category, and what is to come of them; statements are told by their number."""

    name: str
    category: str
    statements: tuple[str, ...]
    #: (question, numbers that answer it, numbers that must not be selected)
    questions: tuple[tuple[str, tuple[int, ...], tuple[int, ...]], ...] = ()
    superseded: tuple[tuple[int, int], ...] = ()
    contradicted: tuple[tuple[int, int], ...] = ()
    edges: tuple[tuple[str, str, str], ...] = ()
    no_edges: tuple[tuple[str, str, str], ...] = ()
    #: (entity, attribute, value) of facts that exactly one live memory states
    facts: tuple[tuple[str, str, str], ...] = ()
    fulfilled: tuple[tuple[int, int], ...] = ()


TIMELINES = (
    Timeline(
        "residence_timeline",
        "profile",
        ("I live in Mumbai.", "I moved to Pune.", "I am planning to move to Bangalore."),
        (("What city do I live in?", (2,), (3,)), ("Where did I live before?", (1,), ()), ("Where am I planning to move?", (3,), ())),
        superseded=((1, 2),),
    ),
    Timeline(
        "long_residence_timeline",
        "profile",
        ("I lived in Delhi.", "I live in Mumbai.", "I moved to Pune.", "I will move to Bangalore next month."),
        (("Where do I live?", (3,), (4,)), ("Where did I live before?", (1, 2), ()), ("Where will I move?", (4,), ())),
        superseded=((1, 2), (2, 3)),
    ),
    Timeline(
        "plan_fulfilment",
        "profile",
        ("I live in Pune.", "I planned to move to Bangalore.", "I moved to Bangalore."),
        (("Where do I live?", (3,), (2, 1)), ("Where did I live before?", (1,), ())),
        superseded=((1, 3),),
        fulfilled=((2, 3),),
    ),
    Timeline("residence_contradiction", "profile", ("I live in Mumbai.", "I live in Pune."), (("Where do I live?", (2,), (1,)),), contradicted=((1, 2),)),
    Timeline("residence_reassertion", "fact", ("I live in Mumbai.", "I live in Pune.", "I live in Mumbai."), (("Where do I live?", (1,), (2,)),), contradicted=((2, 1),), facts=(("user", "residence", "mumbai"),)),
    Timeline("employment_transition", "profile", ("I work at Google.", "I now work at BMW."), (("Where do I work?", (2,), (1,)), ("Where did I work before?", (1,), ())), superseded=((1, 2),)),
    Timeline("negated_residence", "profile", ("I live in Mumbai.", "I do not live in Mumbai anymore."), superseded=((1, 2),)),
    Timeline(
        "entity_separation",
        "fact",
        ("My friend Rahul works at Google.", "Rahul Patel lives in Delhi.", "Rahul Sharma works at BMW."),
        (("Where does Rahul Sharma work?", (3,), ()), ("Where does Rahul Patel live?", (2,), ())),
        edges=(("user", "friend_of", "rahul"), ("rahul", "works_at", "google"), ("rahul patel", "lives_in", "delhi"), ("rahul sharma", "works_at", "bmw")),
        no_edges=(("user", "works_at", "google"), ("user", "works_with", "rahul"), ("user", "works_at", "bmw"), ("user", "lives_in", "delhi")),
    ),
    Timeline("device_reinforcement", "fact", ("I use a MacBook Air.", "I primarily work on my MacBook Air.", "I use my MacBook Air for development."), facts=(("user", "device", "macbook air"),)),
    Timeline("coexisting_preferences", "preference", ("I like coffee.", "I like tea."), (("What do I like?", (1, 2), ()),)),
    Timeline("repeated_low_importance_fact", "fact", ("I live in Pune.", "I live in Pune."), (("Where do I live?", (1,), ()),), facts=(("user", "residence", "pune"),)),
)

#: Quality that the labelled timelines and sentences are to reach.
QUALITY = {
    "precision_at_1": 1.0,
    "recall_at_3": 1.0,
    "mrr": 1.0,
    "ndcg_at_3": 1.0,
    "forbidden_selection_rate": 0.0,
    "supersession_precision": 1.0,
    "supersession_recall": 1.0,
    "contradiction_precision": 1.0,
    "contradiction_recall": 1.0,
    "graph_edge_accuracy": 1.0,
    "duplicate_suppression_accuracy": 1.0,
    "fact_extraction_accuracy": 1.0,
    "temporal_classification_accuracy": 1.0,
}
