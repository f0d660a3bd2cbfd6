"""Raw vendor shapes to the engine's tables: every function is one projection, filter and dedupe over a whole table."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as X
from ..operators.point_in_time import latest


def renamed(raw: DataFrame, columns: dict[str, str], **fixed: Column) -> DataFrame:
    """Columns by new name (those that raw lacks are null text), then fixed expressions."""
    out = raw.select(*((F.col(old) if old in raw.columns else F.lit(None).cast("string")).alias(new) for new, old in columns.items()))
    return out.withColumns(fixed) if fixed else out


def prices(raw: DataFrame, columns: dict[str, str], shares_per_lot: int = 1, own: list[str] = ()) -> DataFrame:
    """ts_code, trade_date and numbers; rows without a code, day or positive close go; the last row of a key stays.

    own: the vendor's own identity of a listing, where its written codes are cut and may meet; listings of one code then stay apart.
    """
    out = renamed(raw, columns | {c: c for c in own}).withColumn("ts_code", X.security_code("ts_code")).withColumn("trade_date", X.date_text(F.col("trade_date").cast("string")))
    numbers = [c for c in columns if c not in ("ts_code", "trade_date")]
    out = out.withColumns({c: N.numeric(F.col(c).cast("string")) for c in numbers})
    if "volume" in numbers:
        out = out.withColumn("volume", F.col("volume") / shares_per_lot)
    return latest(out.where("ts_code <> '' and trade_date is not null and close > 0"), [*own, "ts_code", "trade_date"], []).drop(*own)


def clean_series(raw: DataFrame, keys: list[str], day: str, value: str, order: list[str] = ()) -> DataFrame:
    """Positive finite values of days that can be read, one per key and day (the last by `order`)."""
    out = raw.select(*keys, X.date_text(F.col(day).cast("string")).alias(day), N.numeric(F.col(value).cast("string")).alias(value), *order)
    return latest(out.where(F.col(day).isNotNull() & (F.col(value) > 0)), [*keys, day], list(order)).select(*keys, day, value)


def statements(raw: DataFrame, columns: dict[str, str], source: str, debt_parts: list[str] = (), cash_flow: str | None = None, investment: str | None = None) -> DataFrame:
    """Point-in-time statements: rows without period or announcement go; debt sums its parts with missing ones as 0; free cash flow is flow less investment."""
    out = renamed(raw, columns, source=F.lit(source))
    dates = {c: X.date_text(F.col(c).cast("string")) for c in ("report_period", "announce_date")}
    numbers = {c: N.numeric(F.col(c).cast("string")) for c in columns if c not in ("ts_code", "report_period", "announce_date")}
    out = out.withColumns(dates | numbers).where("report_period is not null and announce_date is not null").withColumn("available_date", F.col("announce_date"))
    if debt_parts:
        total = F.lit(0.0)
        for part in debt_parts:
            total = total + F.coalesce(F.col(part), F.lit(0.0))
        out = out.withColumn("interest_bearing_debt", total)
    if cash_flow:
        out = out.withColumn("free_cash_flow", F.col(cash_flow) - F.col(investment))
    return out


def lifecycle_events(listings: DataFrame, delistings: DataFrame) -> DataFrame:
    """ts_code, event_date, event_type: one LISTED and one DELISTED row at most for a code and day."""
    a = listings.select("ts_code", F.col("list_date").alias("event_date"), F.lit("LISTED").alias("event_type"))
    b = delistings.select("ts_code", F.col("delist_date").alias("event_date"), F.lit("DELISTED").alias("event_type"))
    return a.unionByName(b).where("event_date is not null").distinct()


def merge_lifecycle(known: DataFrame, listings: DataFrame, delistings: DataFrame) -> DataFrame:
    """Securities with the dates of known rows first, then of the calendars; delisted codes that were unknown are added."""
    l = listings.groupBy("ts_code").agg(F.min("list_date").alias("_l"), F.max("name").alias("_n"))  # noqa: E741
    d = delistings.groupBy("ts_code").agg(F.max("delist_date").alias("_d"), F.min("list_date").alias("_dl"), F.max("name").alias("_dn"))
    out = known.withColumn("_known", F.lit(True)).join(l, "ts_code", "left").join(d, "ts_code", "full")
    return out.select(
        "ts_code", F.coalesce("name", "_n", "_dn").alias("name"), F.coalesce("list_date", "_l", "_dl").alias("list_date"), F.coalesce("delist_date", "_d").alias("delist_date"), F.coalesce("_known", F.lit(False)).alias("was_known")
    )


def first_source(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Per key the value of the first source that has one, and its number."""
    rows = sources[0].select(*keys, F.col(value), F.lit(0).alias("source"))
    for k, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select(*keys, F.col(value), F.lit(k).alias("source")))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"))


def investors(raw: DataFrame, created) -> DataFrame:
    """Investors of a register: trimmed codes, cleaned names (rows without either go), joined tags and aliases, addresses, active unless told otherwise."""
    lists = {c: F.nullif(F.array_join(F.filter(F.transform(F.col(c), lambda t: F.trim(t)), lambda t: t != ""), ","), F.lit("")) if dict(raw.dtypes)[c].startswith("array") else F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("aliases", "style_tags")}
    out = raw.select(
        F.trim(F.coalesce(F.col("investor_code").cast("string"), F.lit(""))).alias("investor_code"), X.clean_text("name").alias("name"), lists["aliases"].alias("aliases"), F.nullif(X.clean_text("role"), F.lit("")).alias("role"), lists["style_tags"].alias("style_tags"),
        X.url_or_null("profile_url").alias("profile_url"), F.coalesce(X.truthy(F.col("is_active")), F.lit(True)).alias("is_active"), F.lit(created).cast("timestamp").alias("created_time"),
    ).where("investor_code <> '' and name <> ''")
    return latest(out, ["investor_code"], [])


def investor_accounts(raw: DataFrame, default_platform: str | None = None) -> DataFrame:
    """Accounts of investors on platforms: an account without a number is known by its platform and its own number or name; incomplete rows go."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    platform = F.when(text("platform") != "", text("platform")).otherwise(F.lit(default_platform or ""))
    out = raw.select(text("investor_code").alias("investor_code"), platform.alias("platform"), X.clean_text("account_name").alias("account_name"), F.nullif(text("account_uid"), F.lit("")).alias("account_uid"), text("account_id").alias("account_id"), X.url_or_null("home_url").alias("home_url"), F.coalesce(X.truthy(F.col("is_enabled")), F.lit(True)).alias("is_enabled"))
    out = out.where("investor_code <> '' and account_name <> '' and platform <> ''")
    named = F.concat_ws(":", F.col("platform"), F.coalesce("account_uid", "account_name"))
    return latest(out.withColumn("account_id", F.when(F.col("account_id") != "", F.col("account_id")).otherwise(named)), ["account_id"], [])


def stock_flows(raw: DataFrame, code: str, amounts: list[str], order: list[str]) -> DataFrame:
    """Flow snapshots: amount texts to numbers, six-digit codes only, one row per code."""
    out = raw.where(F.col(code).rlike(r"^\d{6}$")).withColumns({c: X_amount(c) for c in amounts})
    return latest(out, [code], order)


def X_amount(column: str) -> Column:
    return N.amount(F.col(column).cast("string"))


def sector_flows(flows: DataFrame, mapping: DataFrame, by: list[str] = ()) -> DataFrame:
    """Stock flows to sectors: sums of what there is of inflow, outflow, net and turnover (nothing known is 0), number of stocks, name and rate of net flow to turnover in percent.

    A stock that the mapping has twice belongs to its first sector by name; blank sectors do not count.
    """
    named = "name" in mapping.columns
    once = mapping.where(F.trim(F.col("sector").cast("string")) != "").groupBy("stock").agg(F.min(F.struct("sector", *(["name"] if named else []))).alias("_m")).select("stock", "_m.*")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("inflow", "outflow", "net", "turnover") if c in flows.columns]
    out = flows.join(once, "stock").groupBy(*by, "sector").agg(*([F.min("name").alias("name")] if named else []), *sums, F.countDistinct("stock").alias("stocks"))
    return out.withColumn("rate", F.when(F.col("turnover") > 0, F.col("net") * 100 / F.col("turnover")))


def flow_coverage(flows: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: sector_count, stock_matched, stock_total and stock_coverage of sector_flows()."""
    once = mapping.where(F.trim(F.col("sector").cast("string")) != "").groupBy("stock").agg(F.min("sector").alias("sector"))
    out = flows.join(once, "stock", "left").agg(F.countDistinct("sector").alias("sector_count"), F.countDistinct(F.when(F.col("sector").isNotNull(), F.col("stock"))).alias("stock_matched"), F.count(F.lit(1)).alias("stock_total"))
    return out.withColumn("stock_coverage", F.when(F.col("stock_total") > 0, F.round(F.col("stock_matched") / F.col("stock_total"), 4)).otherwise(0.0))


def back_filled_mapping(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """stock, l1, l2: the parent of the second level stands in where a stock has no first level."""
    return leaves.join(parents.select(F.col("code").alias("l2"), F.col("parent").alias("_p")), "l2", "left").select("stock", F.coalesce("l1", "_p").alias("l1"), "l2")


def announcements(raw: DataFrame) -> DataFrame:
    """One row per announcement id, then one per code, day and title (day in UTC+8)."""
    once = latest(raw.withColumn("day", X.epoch_day("publish_time")), ["announcement_id"], ["publish_time"])
    w = Window.partitionBy("ts_code", "day", "title").orderBy("announcement_id")
    return once.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def manual_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of a JSON file, a list or an object with `quotes`; one bad row fails the batch."""
    item = "struct<investor_code: string, platform: string, platform_id: string, content: string, source_url: string, published_at: string, verification: string>"
    raw = spark.read.text(path, wholetext=True).select(
        F.coalesce(F.get_json_object("value", "$.quotes"), F.col("value")).alias("v")
    )
    rows = raw.select(F.explode(F.from_json("v", f"array<{item}>", {"mode": "FAILFAST"})).alias("q")).select("q.*")
    return quotes(rows)


def quotes(raw: DataFrame, ties: list[str] = ()) -> DataFrame:
    """Comments to the engine's quotes: cleaned, long enough, tagged, one per content hash: that of the last id, among equal ids the first by `ties`."""
    c = raw.withColumn("content", X.clean_text("content")).where(F.length("content") >= 4)
    c = c.withColumn("content_hash", X.content_hash("content"))
    verified = F.when(F.col("platform") == "manual", F.coalesce("verification", F.lit("unverified"))).otherwise("unverified")
    c = c.select(
        X.quote_id("platform", "platform_id", "content_hash").alias("quote_id"), "investor_code", "platform", "content", X.summary("content").alias("summary"), "content_hash", X.quote_type("content").alias("quote_type"),
        X.themes("content").alias("themes"), X.stock_codes("content").alias("stock_codes"), X.url_or_null("source_url").alias("source_url"), X.post_time("published_at").alias("published_at"), verified.alias("verification"),
        *((-F.col(t)).alias(f"_{t}") for t in ties),
    )
    return latest(c, ["content_hash"], ["quote_id", *(f"_{t}" for t in ties)]).drop(*(f"_{t}" for t in ties))


def jsonp_rows(raw: Column, schema: str) -> Column:
    """The array inside a call or assignment around JSON."""
    return F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), f"array<{schema}>")


class _Tables(HTMLParser):
    """Cells of every row of every table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data


def holding_tables(pages: DataFrame, key: str, page: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, rank and the named columns of holding tables in pages; a header cell that holds a name's word places its column.

    names: column to the words of its header, such as {"stock": ("代码",), "weight": ("占净值",)}; values stay text.
    """
    columns = list(names)
    schema = ", ".join([f"{key} {dict(pages.dtypes)[key]}", "rank int", *(f"{c} string" for c in columns)])

    def run(batches):
        for pdf in batches:
            out = []
            for k, html in zip(pdf[key], pdf[page], strict=True):
                parser = _Tables()
                parser.feed(html or "")
                places, rank = None, 0
                for row in parser.rows:
                    cells = [" ".join(c.split()) for c in row]
                    found = {c: i for c, words in names.items() for i, cell in enumerate(cells) if any(w in cell for w in words)}
                    if len(found) == len(columns):
                        places, rank = found, 0
                    elif places and len(cells) > max(places.values()):
                        rank += 1
                        out.append((k, rank, *(cells[places[c]] for c in columns)))
            yield type(pdf)(out, columns=[key, "rank", *columns])

    return pages.select(key, page).mapInPandas(run, schema)


def valuation_history(frames: dict[str, DataFrame], columns: tuple[str, ...] = ("pe_ttm", "pe_static", "pb", "ps", "pcf")) -> DataFrame:
    """ts_code, trade_date and all indicators on the days of pe_ttm (of pb if there is no pe_ttm); the others join by day, missing ones are null.

    frames: (ts_code, trade_date, indicator) by indicator; a day that one has twice counts once.
    """
    keys = ["ts_code", "trade_date"]
    base = next((c for c in ("pe_ttm", "pb") if c in frames), None)
    if base is None:
        raise ValueError("neither pe_ttm nor pb is there to give the days")
    out = frames[base].select(*keys, base)
    for column in columns:
        if column == base:
            continue
        if column in frames:
            out = out.join(frames[column].groupBy(*keys).agg(F.max(column).alias(column)), keys, "left")
        else:
            out = out.withColumn(column, F.lit(None).cast("double"))
    return out.select(*keys, *columns)


def index_membership(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ts_code, index_code, index_name, effective_date of constituents: codes without a float's tail, padded to six digits and with their exchange; one row per key."""
    out = renamed(raw, columns)
    code = F.lpad(F.regexp_replace(F.trim(F.col("ts_code").cast("string")), r"\.0$", ""), 6, "0")
    out = out.select(X.security_code(code).alias("ts_code"), F.col("index_code").cast("string").alias("index_code"), F.col("index_name").cast("string").alias("index_name"), X.date_text(F.col("effective_date").cast("string")).alias("effective_date"))
    return latest(out, ["ts_code", "index_code", "effective_date"], [])


def industry_valuation(raw: DataFrame, columns: dict[str, str], stat_date, classification: str) -> DataFrame:
    """Industry valuations of a day: codes and trimmed names as text, everything else as numbers."""
    out = renamed(raw, columns, stat_date=F.lit(stat_date).cast("date"), classification=F.lit(classification))
    numbers = {c: N.numeric(F.col(c).cast("string")) for c in columns if c not in ("industry_code", "industry_name", "industry_level")}
    return out.withColumns(numbers | {"industry_code": F.col("industry_code").cast("string"), "industry_name": F.trim("industry_name"), "industry_level": F.col("industry_level").cast("string").try_cast("int")})


def company_profile(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ts_code, industry, list_date, index_membership: placeholders are blank, dates that cannot be read null."""
    out = renamed(raw, columns)
    return out.select("ts_code", X.placeholder("industry").alias("industry"), X.date_text(F.col("list_date").cast("string")).alias("list_date"), X.placeholder("index_membership").alias("index_membership"))


def vendor_sector_flows(raw: DataFrame, columns: dict[str, str], trade_date, sector_type: str, top: int | None = None) -> DataFrame:
    """Sector flows of a vendor: net of the four order sizes (of the main flow if the vendor gives no sizes), the rate as given, gross flows null.

    top keeps the first rows of the vendor's own order (column `place`), as its report does.
    """
    sizes = [c for c in ("super_net_inflow", "large_net_inflow", "medium_net_inflow", "small_net_inflow") if columns.get(c) in raw.columns]
    out = renamed(raw, columns)
    out = out.withColumns({c: N.numeric(F.col(c).cast("string")) for c in columns if c not in ("sector_code", "sector_name", "place")})
    net = sum((F.col(c) for c in sizes[1:]), F.col(sizes[0])) if sizes else F.col("main_net_inflow")
    none = F.lit(None).cast("double")
    out = out.select("sector_code", "sector_name", F.lit(sector_type).alias("sector_type"), F.lit(trade_date).cast("date").alias("trade_date"), none.alias("inflow"), none.alias("outflow"), net.alias("net_inflow"),
                     F.col("main_net_inflow_rate").alias("net_inflow_rate"), "main_net_inflow", F.col("small_net_inflow").alias("retail_net_inflow"), *(["place"] if "place" in columns else []))
    return out.where(F.col("place").cast("int") <= top) if top and "place" in columns else out
