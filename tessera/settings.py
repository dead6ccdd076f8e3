"""Settings with defaults; each can be given in the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Folder of the tables, selection limit and budget of a context, pool of structural candidates, vector width."""

    warehouse: str = "warehouse"
    context_retrieval_limit: int = 10
    context_token_budget: int = 1200
    structural_candidate_limit: int = 50
    embedding_width: int = 64


def load(environ: dict[str, str] | None = None) -> Settings:
    """Settings from the environment by the upper-case names; blank values are the defaults.

    ValueError if a number is none, or the candidate limit or the width is negative.
    """
    env, got = os.environ if environ is None else environ, {}
    for f in fields(Settings):
        raw = (env.get(f.name.upper()) or "").strip()
        if not raw:
            continue
        if isinstance(f.default, str):
            got[f.name] = raw
            continue
        try:
            got[f.name] = int(raw)
        except ValueError as e:
            raise ValueError(f"{f.name.upper()} must be a whole number, not {raw!r}") from e
        if f.name in ("structural_candidate_limit", "embedding_width") and got[f.name] < 0:
            raise ValueError(f"{f.name.upper()} must not be negative")
    return Settings(**got)
