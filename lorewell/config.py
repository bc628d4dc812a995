"""Engine settings from the environment.

The engine reads rag_top_k and max_history; the other fields are for plug-ins (embedders, generators) and front ends.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    temperature: float = 0.8
    max_history: int = 10
    rag_top_k: int = 3
    rag_enabled: bool = True
    verbose: bool = True
    app_title: str = "lorewell"
    vector_db_path: str = "./data/vector_db"
    embedding_model: str = "embedding-3"
    embedding_dim: int = 256


def _cast(kind: str, text: str):
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes", "on")
    return {"float": float, "int": int, "str": str}[kind](text)


def read_dotenv(path: str) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and # comments are skipped."""
    file = Path(path)
    if not file.exists():
        return {}
    rows = (line.strip() for line in file.read_text(encoding="utf-8").splitlines())
    pairs = (row.split("=", 1) for row in rows if row and not row.startswith("#") and "=" in row)
    return {k.strip().upper(): v.strip().strip("\"'") for k, v in pairs}


def load_settings(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    """Environment variables win over the file; unknown keys are ignored."""
    given = read_dotenv(env_file) | {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    found = {f: _cast(t, given[f.upper()]) for f, t in Settings.__annotations__.items() if f.upper() in given}
    return Settings(**found)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    return load_settings()
