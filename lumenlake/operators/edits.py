"""Receipt corrections as sent by people: checked, tidied and folded into one correction a receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("receipt", "shop", "date", "total", "currency")
#: Currencies that a correction may name (fixed values).
CURRENCIES = ("₹", "$", "€", "£", "")


def normalise_fixes(edits: DataFrame, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fixes, rejects) of edits (id, moment, sent: map<string,string>).

    fixes: id, fix: the edits of each id in the order of `moment`, laid over its earlier fix (id, fix). A key
    that was not sent stays; a null value is kept as such. Shops lose extra white space and are cut to 80
    characters; totals are rounded to two places. receipt = null takes the key away, receipt = false all others;
    a null map undoes everything before it. Ids left with no key have no row. An id's edits are few: a person made them.
    rejects: edits with their reason: a date that is none, a total below 0 or from 1e9, a currency not known.
    """
    has = lambda k: F.map_contains_key("sent", F.lit(k))
    value = lambda k: F.try_element_at(F.col("sent"), F.lit(k))
    total = value("total").try_cast("double")
    date = F.when(value("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value("date"), "yyyy-MM-dd"))
    reason = (
        F.when(value("date").isNotNull() & date.isNull(), "date")
        .when(value("total").isNotNull() & ~F.coalesce((total >= 0) & (total < 1e9), F.lit(False)), "total")
        .when(has("currency") & ~F.coalesce(value("currency").isin(*CURRENCIES), F.lit(False)), "currency")
    )
    checked = edits.withColumn("reason", F.when(F.col("sent").isNotNull(), reason))

    def tidy(k, v):
        shop = F.substring(F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), "^ | $", ""), 1, 80)
        return F.when(k == "shop", F.when(shop != "", shop)).when(k == "total", F.round(v.try_cast("double"), 2).cast("string")).otherwise(v)

    good = checked.where("reason is null").select("id", "moment", F.transform_values(F.map_filter("sent", lambda k, v: k.isin(*FIELDS)), tidy).alias("sent"))
    if earlier is not None:
        good = good.unionByName(earlier.join(good.select("id").distinct(), "id", "left_semi").select("id", F.lit(None).cast(dict(good.dtypes)["moment"]).alias("moment"), F.col("fix").alias("sent")))
    order = F.array_sort(F.collect_list(F.struct(F.col("moment").isNotNull().alias("later"), "moment", F.map_entries("sent").alias("sent"))))
    empty = F.create_map().cast("map<string,string>")

    def lay(fix, edit):
        sent = F.map_from_entries(edit["sent"])
        kept = F.map_filter(fix, lambda k, v: ~F.map_contains_key(sent, k))
        both = F.map_filter(F.map_concat(kept, sent), lambda k, v: (k != "receipt") | v.isNotNull())
        no = F.try_element_at(both, F.lit("receipt")) == "false"
        return F.when(edit["sent"].isNull(), empty).when(no, F.map_filter(both, lambda k, v: k == "receipt")).otherwise(both)

    fixes = good.groupBy("id").agg(order.alias("all")).select("id", F.aggregate("all", empty, lay).alias("fix"))
    return fixes.where(F.size("fix") > 0), checked.where("reason is not null")
