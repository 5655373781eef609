"""Contracts and collections from JSON documents with everything that may be missing."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from quillon.operators import receivables as r


def _store(spark, contracts, collections, *more):
    return spark.createDataFrame([("contracts", json.dumps(contracts)), ("collections", json.dumps(collections)), ("contracts", "not json"), ("collections", None), ("staff", "[]"), *more], "name string, data string")


def test_periods_by_frequency_and_clamped_days(spark):
    base = {"effective_date": "2024-01-31", "subscription_end_date": "2024-04-30", "yearly_fee": 1200.0, "unknown": 1}
    contracts = [
        base | {"id": "m", "billing_frequency": "Monthly"}, base | {"id": "q"}, base | {"id": "y", "billing_frequency": "annually"}, base | {"id": "o", "billing_frequency": "one-time", "subscription_end_date": None},
        base | {"id": "renews", "auto_renewal": True, "billing_frequency": "annually"}, base | {"id": "no start", "effective_date": ""}, base | {"id": "no end", "subscription_end_date": ""}, base | {"id": "before", "subscription_end_date": "2023-01-01"},
        {"id": "other days", "initial_delivery_date": "2023-01-30", "termination_date": "2023-02-28", "billing_frequency": "monthly", "quarterly_fee": 7.0},
    ]
    rows = r.periods(r.contracts_of(_store(spark, contracts, {})), F.lit("2024-06-01").cast("date")).collect()
    got = {}
    for x in rows:
        got.setdefault(x.id, []).append((str(x.due), x.period_amount))
    assert {k: sorted(v) for k, v in got.items()} == {
        "m": [("2024-01-31", 100.0), ("2024-02-29", 100.0), ("2024-03-31", 100.0), ("2024-04-30", 100.0)], "q": [("2024-01-31", 300.0), ("2024-04-30", 300.0)], "y": [("2024-01-31", 1200.0)], "o": [("2024-01-31", 1200.0)],
        "renews": [("2024-01-31", 1200.0), ("2025-01-31", 1200.0)], "other days": [("2023-01-30", 0.0), ("2023-02-28", 0.0)],
    }


def test_stages_and_payouts(spark):
    shares = [{"owner": "A", "ratio": 0.25, "mode": "ratio"}, {"owner": "B", "amount": 60.0, "mode": "amount"}, {"owner": "gone", "ratio": 0.0}, {"owner": "null"}]
    c = {"effective_date": "2024-01-01", "billing_frequency": "one-time", "yearly_fee": 120.0, "payment_terms_days": 10, "revenue_shares": shares}
    names = ["later", "due", "waiting", "overdue", "payout", "done", "no partners", "two signed"]
    contracts = [c | {"id": n, "currency": "usd" if n == "due" else None} for n in names]
    contracts[0]["effective_date"], contracts[6]["revenue_shares"] = "2024-03-01", None
    signed, steps = dict.fromkeys(("manager", "accounting", "ar", "invoiced"), True), dict.fromkeys(("tax_invoice", "expense", "paid"), True)
    key = lambda n: f"{n}|2024-01-01"
    records = {
        key("waiting"): {"invoiced": True, "invoiced_at": "2024-02-15"}, key("overdue"): {"invoiced": True}, key("payout"): signed | {"paid_at": "2024-02-01", "payout": {"A": steps, "B": steps | {"paid": None}}}, key("done"): signed | {"payout": {"A": steps, "B": steps, "C": {}}},
        key("no partners"): signed, key("two signed"): signed | {"ar": False, "invoiced_at": "bad"}, "broken key": signed, "due|2023-12-31": signed,
    }
    store = _store(spark, contracts, records)
    out = {x.id: x for x in r.receivables(r.contracts_of(store), r.collections_of(store), F.lit("2024-02-20").cast("date"), 1000.0).collect()}
    assert {n: x.stage for n, x in out.items()} == {"later": "planned", "due": "to_invoice", "waiting": "waiting", "overdue": "overdue", "payout": "payout", "done": "done", "no partners": "done", "two signed": "overdue"}
    assert out["due"].base_amount == 120_000 and out["later"].base_amount == 120 and out["due"].payment_due is None
    assert [tuple(p) for p in out["payout"].payouts] == [("A", 30.0, True), ("B", 60.0, False)] and out["no partners"].payouts == []
    assert out["payout"].payout_due == dt.date(2024, 4, 30) and out["overdue"].payment_due == dt.date(2024, 1, 11) and out["waiting"].payout_due is None
    assert r.receivables(r.contracts_of(store.limit(0)), r.collections_of(store.limit(0)), F.current_date(), 1.0).count() == 0
