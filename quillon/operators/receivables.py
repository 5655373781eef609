"""Contracts and collections kept as nested JSON documents: periods, stages and what partners get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = "struct<owner:string,ratio:double,amount:double,mode:string>"
CONTRACTS = f"""array<struct<id:string,customer_id:string,billing_frequency:string,auto_renewal:boolean,effective_date:string,initial_delivery_date:string,subscription_end_date:string,
termination_date:string,yearly_fee:double,quarterly_fee:double,currency:string,payment_terms_days:int,revenue_shares:array<{SHARE}>>>"""
STEPS = "struct<tax_invoice:boolean,expense:boolean,paid:boolean>"
COLLECTIONS = f"map<string,struct<manager:boolean,accounting:boolean,ar:boolean,invoiced:boolean,invoiced_at:string,paid_at:string,payout:map<string,{STEPS}>>>"
#: Months between two collections (any other frequency: a quarter) and the most collections of a contract.
MONTHS, MOST = {"monthly": 1, "annually": 12}, 600


def contracts_of(store: DataFrame) -> DataFrame:
    """A row per contract of the documents named ``contracts`` in ``store`` (``name, data``); what doesn't parse has none."""
    return store.where("name = 'contracts'").select(F.explode(F.from_json("data", CONTRACTS)).alias("c")).select("c.*")


def collections_of(store: DataFrame) -> DataFrame:
    """``contract_id, due`` and the record of every period in the documents named ``collections``, whose keys are contract|due date."""
    each = store.where("name = 'collections'").select(F.explode(F.from_json("data", COLLECTIONS)).alias("key", "record"))
    return each.select(F.substring_index("key", "|", 1).alias("contract_id"), F.substring_index("key", "|", -1).try_cast("date").alias("due"), "record")


def _day(*names: str) -> Column:
    return F.coalesce(*(F.col(n).try_cast("date") for n in names))


def periods(contracts: DataFrame, today: Column) -> DataFrame:
    """``contracts`` with a row per collection: ``due`` and ``period_amount``. From the effective day (else the first delivery) to the end of the
    subscription (else the termination), every month, quarter or year; a day that a month lacks is its last. Contracts that renew
    themselves go on to a year from today. One-time contracts have one collection; contracts without a start, or an end, none."""
    often = F.lower(F.coalesce("billing_frequency", F.lit("quarterly")))
    once = often == "one-time"
    start, end = _day("effective_date", "initial_delivery_date"), _day("subscription_end_date", "termination_date")
    end = F.when(F.col("auto_renewal") & (end < F.date_add(today, 365)), F.date_add(today, 365)).otherwise(end)
    step = F.coalesce(*(F.when(often == k, n) for k, n in MONTHS.items()), F.lit(3))
    yearly = F.coalesce("yearly_fee", F.lit(0.0))
    quarter = F.coalesce(F.nullif("quarterly_fee", F.lit(0.0)), yearly / 4)
    amount = F.when(once | (often == "annually"), yearly).when(often == "monthly", yearly / 12).otherwise(quarter)
    reach = F.least(F.lit(MOST - 1), F.floor(F.months_between(end, start) / step).cast("int") + 1)  # one more than whole steps: clamped days
    dues = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), reach)), lambda k: F.add_months(start, k * step)), lambda d: d <= end)
    listed = F.when(start.isNull(), None).when(once, F.array(start)).when(end >= start, dues)
    return contracts.withColumn("due", F.explode(listed)).withColumn("period_amount", F.round(amount, 2))


def effective_shares(shares: Column, yearly: Column) -> Column:
    """owner and share of each active partner: its ratio, or its amount as a share of the yearly fee (0 without one)."""
    fixed = lambda s: F.coalesce(s["mode"], F.lit("ratio")) == "amount"
    active = F.filter(F.coalesce(shares, F.array().cast(f"array<{SHARE}>")), lambda s: F.coalesce(F.when(fixed(s), s["amount"]).otherwise(s["ratio"]) > 0, F.lit(False)))
    return F.transform(active, lambda s: F.struct(s["owner"].alias("owner"), F.when(fixed(s), F.coalesce(s["amount"] / F.nullif(yearly, F.lit(0.0)), F.lit(0.0))).otherwise(s["ratio"]).alias("share")))


def receivables(contracts: DataFrame, collections: DataFrame, today: Column, usd_rate: float) -> DataFrame:
    """A row per collection of every contract: ``id, due, period_amount, base_amount`` (dollars by the rate, others as they are), ``stage`` (planned,
    to_invoice, waiting, overdue, payout, done), ``payment_due`` (terms after invoicing, once invoiced), ``payout_due`` (end of the next quarter's
    first month, once paid), and ``payouts``: owner, amount and done of each active partner. A collection is paid once manager,
    accounting and receivables have signed; a partner is done after all its three steps; missing flags are false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = periods(contracts, today).join(collections.withColumnsRenamed({"contract_id": "__c", "due": "__d"}), (F.col("id") == F.col("__c")) & (F.col("due") == F.col("__d")), "left")
    invoiced = flag(F.col("record.invoiced"))
    paid = flag(F.col("record.manager")) & flag(F.col("record.accounting")) & flag(F.col("record.ar"))
    sent = F.coalesce(F.col("record.invoiced_at").try_cast("date"), "due")
    payment_due = F.when(invoiced, F.date_add(sent, F.coalesce("payment_terms_days", F.lit(30))))
    received = F.when(paid, F.coalesce(F.col("record.paid_at").try_cast("date"), "due"))
    done = F.map_filter(F.coalesce("record.payout", F.create_map().cast(f"map<string,{STEPS}>")), lambda _, s: flag(s["tax_invoice"]) & flag(s["expense"]) & flag(s["paid"]))
    shares = effective_shares(F.col("revenue_shares"), F.coalesce("yearly_fee", F.lit(0.0)))
    payouts = F.transform(shares, lambda s: F.struct(s["owner"].alias("owner"), (F.col("period_amount") * s["share"]).alias("amount"), F.coalesce(F.map_contains_key(done, s["owner"]), F.lit(False)).alias("done")))
    rows = rows.withColumn("payouts", payouts)
    stage = (
        F.when(~invoiced, F.when(F.col("due") > today, "planned").otherwise("to_invoice")).when(~paid, F.when(payment_due < today, "overdue").otherwise("waiting"))
        .when(F.exists("payouts", lambda p: ~p["done"]), "payout").otherwise("done")
    )
    usd = F.upper(F.coalesce("currency", F.lit("KRW"))) == "USD"
    next_month = F.last_day(F.add_months(F.date_trunc("quarter", received).cast("date"), 3))
    columns = {"base_amount": F.when(usd, F.col("period_amount") * usd_rate).otherwise(F.col("period_amount")), "stage": stage, "payment_due": payment_due, "payout_due": next_month}
    return rows.withColumns(columns).select("id", "due", "period_amount", *columns, "payouts")
