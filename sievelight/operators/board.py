"""Work-item table audit over `items(source, id, status, scorecard, what, done_when, owner, evidence, line)`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import text_or_empty
from sievelight.operators.findings import from_hits, hit, hits

# Proof markers and what a status asks for.
PROOFS = {"F2P": "missing-f2p", "P2P": "missing-p2p"}
STATUS_RULES = {"DONE": "done-without-evidence", "BLOCKED": "blocked-without-next"}


def _check(failed: Column, kind: str, words: str) -> tuple[Column, Column]:
    return failed, hit(kind, F.concat(F.col("id"), F.lit(f" {words}")), F.col("line"), F.col("id"))


def _proof_checks() -> list:
    cell = text_or_empty(F.col("done_when"))
    return [_check(~cell.rlike(f"(?i){mark}"), kind, f"has no {mark} proof line") for mark, kind in PROOFS.items()]


def _owner_checks() -> list:
    return [
        _check(text_or_empty(F.col("owner")) == "", "missing-owner", "names no owner role"),
        _check(text_or_empty(F.col("scorecard")) == "", "missing-scorecard", "names no scorecard row"),
    ]


def _status_checks(rules: Mapping[str, str]) -> list:
    empty = text_or_empty(F.col("evidence")) == ""
    status = F.upper(text_or_empty(F.col("status")))
    return [_check((status == s.upper()) & empty, kind, f"is {s} with empty evidence") for s, kind in rules.items()]


def board_proofs(items: DataFrame) -> DataFrame:
    """Items whose done-when cell lacks a proof marker."""
    return from_hits(items, hits(*_proof_checks()))


def board_owner(items: DataFrame) -> DataFrame:
    return from_hits(items, hits(*_owner_checks()))


def board_status(items: DataFrame, rules: Mapping[str, str] = STATUS_RULES) -> DataFrame:
    """Items whose status asks for evidence while the evidence cell is empty."""
    return from_hits(items, hits(*_status_checks(rules)))


def board_findings(items: DataFrame, rules: Mapping[str, str] = STATUS_RULES) -> DataFrame:
    """All six checks in one scan."""
    return from_hits(items, hits(*_proof_checks(), *_owner_checks(), *_status_checks(rules)))
