"""Recall capsules: ranked items packed into a budget of items and characters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items, characters of a summary, and characters of a packet for each budget.
BUDGETS = {"micro": (3, 420, 1800), "small": (5, 550, 3500), "medium": (7, 750, 7000), "large": (10, 950, 12000)}
ORDER = list(BUDGETS)
COMPACT_SUMMARY = 120


def next_budget(name: Column) -> Column:
    """The next larger budget; the largest stays."""
    found = F.when(name == ORDER[0], ORDER[1])
    for a, b in zip(ORDER[1:], [*ORDER[2:], ORDER[-1]], strict=True):
        found = found.when(name == a, b)
    return found


def trimmed(text: str | None, limit: int) -> str:
    text = (text or "").strip()
    return text if len(text) <= limit else text[: limit - 3].rstrip() + "..."


def json_chars(value) -> int:
    """Characters of JSON with sorted keys, other scripts as they are."""
    return len(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str))


def capsule_item(item: dict, summary_chars: int, compact: bool = False) -> dict:
    """What of an item goes into a capsule: bounded texts, three sources and relations at most (one and none if compact)."""
    sources, relations = (1, 0) if compact else (3, 3)
    kept = {k: item.get(k) for k in ("id", "kind", "wiki_id", "namespace", "version", "confidence", "match_confidence", "score")}
    kept["title"] = trimmed(item.get("title"), 180)
    kept["summary"] = trimmed(item.get("summary") or item.get("content"), summary_chars)
    kept["rank_signals"] = list(item.get("rank_signals") or [])
    kept["provenance"] = [dict(e) | {"path": trimmed(e.get("path"), 160), "source_url": trimmed(e.get("source_url"), 160), "quote_hint": trimmed(e.get("quote_hint"), 120)} for e in list(item.get("provenance") or [])[:sources]]
    kept["relationships"] = [dict(r) | {"evidence": trimmed(r.get("evidence"), 120)} for r in list(item.get("relationships") or [])[:relations]]
    return kept


def pack_items(ranked: list[dict], budget: str) -> tuple[list[dict], int]:
    """The items that fit, best first, and their size: an item that doesn't fit is passed over, the first is compacted."""
    items, summary, packet = BUDGETS[budget]
    selected: list[dict] = []
    for item in ranked[:items]:
        for compact in (False, True):
            if compact and selected:
                break
            tried = [*selected, capsule_item(item, COMPACT_SUMMARY if compact else summary, compact)]
            if json_chars(tried) <= packet:
                selected = tried
                break
    return selected, json_chars(selected)


def build_capsules(ranked: DataFrame, budget: str = "medium") -> DataFrame:
    """(query_id, selected, available, truncated, estimated_chars, capsule) from ranked items.

    ranked: query_id, rank from 1, and the fields of an item. Rows beyond the budget's items count as available but
    are cut before they are gathered, so a group is never larger than the budget.
    """
    limit = BUDGETS[budget][0]
    fields = [c for c in ranked.columns if c not in ("query_id", "rank")]
    some = F.when(F.col("rank") <= limit, F.struct("rank", *fields))
    grouped = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("available"), F.to_json(F.array_sort(F.collect_list(some))).alias("_items"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for q, n, items in zip(part["query_id"], part["available"], part["_items"], strict=True):
                selected, chars = pack_items(json.loads(items), budget)
                out.append((q, len(selected), n, len(selected) < n, chars, json.dumps(selected, ensure_ascii=False, sort_keys=True)))
            yield pd.DataFrame(out, columns=["query_id", "selected", "available", "truncated", "estimated_chars", "capsule"])

    kind = dict(ranked.dtypes)["query_id"]
    return grouped.select("query_id", "available", "_items").mapInPandas(pack, f"query_id {kind}, selected int, available long, truncated boolean, estimated_chars long, capsule string")


def abstains(results: Column, best_confidence: Column) -> Column:
    """No results, or the best one is weak."""
    return (results == 0) | F.coalesce(best_confidence == "weak", F.lit(True))


def answer_warnings(results: Column, best_confidence: Column, truncated: Column) -> Column:
    return F.array_compact(F.array(F.when(truncated, "CONTEXT_BUDGET_TRUNCATED"), F.when(results == 0, "NO_RESULTS"), F.when((results > 0) & (best_confidence == "weak"), "WEAK_MATCHES_ONLY")))


def context_pack(sections: DataFrame, max_chars: int, by: list[str], order: list[Column], text: str = "section") -> DataFrame:
    """The sections of each group, in order, that fit into max_chars with two characters between them; the last is cut.

    Adds ``packed`` (what of the section goes in). Groups are those of one request.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0))
    room = F.lit(max_chars) - used
    return sections.withColumn("_room", room).where("_room > 0").withColumn("packed", F.substring(F.col(text), F.lit(1), F.col("_room").cast("int"))).drop("_room")
