"""Reports over companies, users, cards, products and their transactions.

Dimensions are joined on their keys without hints: Spark broadcasts a side only
when its measured size is under the session's threshold, and splits skewed
shuffle partitions otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.constants import ACTIVE, INACTIVE, VOLUME_LABELS, VOLUME_THRESHOLD
from slotwise.functions import dates, text
from slotwise.functions.numbers import mean_money
from slotwise.operators.grouping import last_n_per_group

REPORT_NAMES = [
    "transaction_id", "user_name", "user_surname", "card_iban", "company_name", "amount",
    "transaction_date", "transaction_time", "lat", "longitude", "declined",
    "card_expiry", "user_country", "company_country",
]


def accepted(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("declined") == 0)


def sales_with_company(tx: DataFrame, company: DataFrame) -> DataFrame:
    """Accepted transactions joined with their company; company columns keep their names."""
    return accepted(tx).join(company.withColumnRenamed("id", "company_id"), "company_id")


def companies_with_sale_above_mean(tx: DataFrame, company: DataFrame) -> DataFrame:
    """Names of companies with at least one accepted sale above the rounded overall mean."""
    sales = accepted(tx)
    mean = sales.agg(F.round(F.avg("amount"), 2).alias("m")).scalar()
    above = sales.where(F.col("amount") > mean)
    return company.join(above, company["id"] == above["company_id"], "left_semi").select("company_name").distinct()


def companies_without_transactions(tx: DataFrame, company: DataFrame, literal: bool = False) -> DataFrame:
    """Companies no transaction refers to.

    ``literal=True`` gives the uncorrelated form of the question: every company when
    there is no transaction at all, otherwise none.
    """
    if literal:
        any_tx = tx.select(F.lit(1).alias("x")).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
        return company.where(any_tx == 0).select("company_name")
    return company.join(tx, company["id"] == tx["company_id"], "left_anti").select("company_name")


def country_of(company: DataFrame, name: str) -> Column:
    """Country of one named company as a scalar subquery (an error when the name is not unique)."""
    return company.where(F.col("company_name") == name).select("country").scalar()


def transactions_in_country_of(tx: DataFrame, company: DataFrame, name: str) -> DataFrame:
    """Accepted transactions of all companies in the country of a named company."""
    same = company.where(F.col("country") == country_of(company, name))
    return accepted(tx).join(same, tx["company_id"] == same["id"], "left_semi")


def volume_label(n: Column, threshold: int = VOLUME_THRESHOLD) -> Column:
    below, equal, above = VOLUME_LABELS
    return F.when(n < threshold, below).when(n == threshold, equal).otherwise(above)


def company_volume(tx: DataFrame, company: DataFrame, threshold: int = VOLUME_THRESHOLD) -> DataFrame:
    """Accepted transactions per company name with a volume label (equal names are merged)."""
    counts = sales_with_company(tx, company).groupBy("company_name").agg(F.count("id").alias("n_transactions"))
    return counts.withColumn("comment", volume_label(F.col("n_transactions"), threshold))


def marketing_view(tx: DataFrame, company: DataFrame) -> DataFrame:
    """Mean purchase per company with its contact data."""
    return sales_with_company(tx, company).groupBy("company_name", "phone", "country").agg(
        mean_money(F.col("amount")).alias("average_purchases")
    )


def technical_report(tx: DataFrame, company: DataFrame, users: DataFrame, cards: DataFrame) -> DataFrame:
    """Transaction joined with company, user and card under report column names."""
    c, u, k = company.alias("c"), users.alias("u"), cards.alias("k")
    star = (
        tx.alias("t")
        .join(c, F.col("t.company_id") == F.col("c.id"))
        .join(u, F.col("t.user_id") == F.col("u.id"))
        .join(k, F.col("t.card_id") == F.col("k.id"))
    )
    return star.select(
        "t.id", "u.name", "u.surname", "k.iban", "c.company_name", "t.amount",
        F.to_date("t.timestamp"), dates.time_of_day(F.col("t.timestamp")), "t.lat", "t.longitude", "t.declined",
        "k.expiring_date", "u.country", "c.country",
    ).toDF(*REPORT_NAMES)


def union_tagged(parts: dict[str, DataFrame], tag: str = "region") -> DataFrame:
    """All rows of the parts with the part's label in ``tag``."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(label)) for label, df in parts.items()])


def heavy_users(tx: DataFrame, users: DataFrame, more_than: int = 80) -> DataFrame:
    """Users with more than the given number of transactions (declined ones count)."""
    counts = tx.groupBy("user_id").agg(F.count("id").alias("total_transactions"))
    heavy = counts.where(F.col("total_transactions") > more_than)
    return users.join(heavy, users["id"] == heavy["user_id"]).select("id", "name", "surname", "total_transactions")


def card_means_of_company(tx: DataFrame, cards: DataFrame, company: DataFrame, name: str) -> DataFrame:
    """Mean amount per card in one company; the IBAN follows from the card."""
    one = company.where(F.col("company_name") == name).select(F.col("id").alias("company_id"))
    rows = tx.join(one, "company_id").join(cards.select(F.col("id").alias("card_id"), "iban"), "card_id")
    return rows.groupBy("card_id", "company_id", "iban").agg(mean_money(F.col("amount")).alias("mean")).drop("company_id")


def card_status(tx: DataFrame, last: int = 3) -> DataFrame:
    """Inactive when the last three transactions were all declined; shorter histories stay active."""
    recent = last_n_per_group(tx, ["card_id"], [F.desc("timestamp"), F.desc("id")], last)
    declined = F.sum(F.col("declined").cast("int"))
    return recent.groupBy("card_id").agg(F.when(declined == last, INACTIVE).otherwise(ACTIVE).alias("status"))


def product_bridge(tx: DataFrame, products: DataFrame) -> DataFrame:
    """One row per transaction and distinct known product of its list.

    The whole list is exploded and joined on equality.
    """
    items = text.list_items(F.col("product_ids"), ",")
    exploded = tx.select(F.col("id").alias("transaction_id"), F.explode(items).alias("product_id"))
    known = products.select(F.col("id").cast("string").alias("product_id"))
    return exploded.join(known, "product_id").select("transaction_id", "product_id")


def product_sales(bridge: DataFrame, tx: DataFrame) -> DataFrame:
    """How often each product was sold in accepted transactions."""
    sold = bridge.join(accepted(tx).select(F.col("id").alias("transaction_id")), "transaction_id")
    return sold.groupBy("product_id").agg(F.count(F.lit(1)).alias("quantity"))
