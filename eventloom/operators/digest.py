"""Digest text: the block list, its order and its Markdown; a digest has some ten items, so this is driver code."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Block = tuple[str, object]


def mechanism_first(rows: DataFrame, signed: Column, mechanism: Column, rank: str) -> DataFrame:
    """Rows the system can say something about first, each part in the given order."""
    return rows.orderBy(F.when(F.coalesce(signed, F.lit(False)) | F.coalesce(mechanism, F.lit(False)), 0).otherwise(1), rank)


def day(published: str | None) -> str:
    return published[:10] if published else "undated"


def item_blocks(items: Iterable[dict], readings: dict[int, str] | None = None) -> list[Block]:
    """Blocks of chosen items (id, claim, quote, lab, published_at, url)."""
    out: list[Block] = []
    for i, item in enumerate(items, 1):
        out += [("h3", f"{i}. {item['claim']}"), ("meta", f"{item['lab']}, {day(item['published_at'])}"), ("quote", item["quote"])]
        if readings and item["id"] in readings:
            out.append(("p", readings[item["id"]]))
        out.append(("link", ("source", item["url"])))
    return out


_LINES = {"h1": "# {}", "h2": "## {}", "h3": "### {}", "meta": "*{}*", "quote": "> {}", "bullet": "- {}", "p": "{}"}


def to_markdown(blocks: Iterable[Block]) -> str:
    """Blocks as Markdown, a blank line between them; unknown kinds raise."""
    out = []
    for kind, content in blocks:
        if kind == "rule":
            out.append("---")
        elif kind == "link":
            out.append("[{}]({})".format(*content))
        else:
            out.append(_LINES[kind].format(content))
    return "\n\n".join(out) + "\n" if out else ""


def newest(names: Iterable[str], persona: str = "") -> str | None:
    """The digest of the latest end date and, within it, the widest span; names are end-spand-persona.md."""

    def key(name: str) -> tuple:
        m = re.match(r"(\d{4}-\d{2}-\d{2})-(\d+)d-", name)
        return (m[1], int(m[2]), name) if m else ("", 0, name)

    return max((n for n in names if persona in n), key=key, default=None)
