"""Registered queries over the chat domain: name -> (query, its DuckDB form or None)."""

from __future__ import annotations

from collections.abc import Callable

from . import catalogue, chat, content, models, rows, streams

ALL: dict = {**chat.Q, **rows.Q, **models.Q, **catalogue.Q, **content.Q, **streams.Q}


def queries() -> dict[str, Callable]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
