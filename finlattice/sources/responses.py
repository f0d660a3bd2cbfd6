"""Pages of posts as two forums answer them, parsed as VARIANT: posts that are whole, and every other with the reason why not.

A response is an object with a list of items; items that are no objects, without an identifier or without a text become rows of the
reject table, and so does a response of another shape, with the fields it has.  Nothing is dropped in silence and nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = ("response", "item", "platform", "platform_id", "account_name", "source_url", "published_at", "content", "meta")


def _text(item: Column, *names: str) -> Column:
    """The first of these fields that is there and is neither empty, zero nor false, as text."""
    found = [F.try_variant_get(item, f"$.{n}", "string") for n in names]
    return F.coalesce(*(F.when(~x.isin("", "0", "false"), x) for x in found))


def _meta(item: Column, **names: str) -> Column:
    return F.to_json(F.struct(*(F.try_variant_get(item, f"$.{n}", "string").alias(k) for k, n in names.items())))


def _items(responses: DataFrame, key: str, payload: str, places: tuple[str, ...], needs: str) -> tuple[DataFrame, DataFrame]:
    """(response, account, item, v) of the items of the first place that is a list, and the rejected responses."""
    v = F.try_parse_json(F.col(payload))
    top = F.schema_of_variant(v)
    lists = [F.try_variant_get(v, p, "array<variant>") for p in places]
    fields = F.array_join(F.slice(F.array_sort(F.json_object_keys(F.col(payload))), 1, 8), ", ")
    reason = F.when(F.col(payload).isNull() | v.isNull(), "no JSON").when(~top.startswith("OBJECT"), "no object at the top").when(F.coalesce(*lists).isNull(), F.concat(F.lit(f"no {needs}; fields: "), fields))
    rows = responses.select(F.col(key).alias("response"), (F.col("account_name") if "account_name" in responses.columns else F.lit(None).cast("string")).alias("account"), F.coalesce(*lists).alias("items"), reason.alias("reason"))
    bad = rows.where("reason is not null").select("response", F.lit(None).cast("int").alias("item"), "reason")
    good = rows.where("reason is null").select("response", "account", F.posexplode("items").alias("item", "v"))
    return good, bad


def _split(items: DataFrame, bad: DataFrame, reason: Column, row: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    told = items.withColumn("reason", F.when(~is_object, "no object").otherwise(reason))
    posts = told.where("reason is null").select("response", "item", *(c.alias(n) for n, c in row.items())).select(*_OUT)
    return posts, bad.unionByName(told.where("reason is not null").select("response", "item", "reason"))


def board_posts(responses: DataFrame, key: str = "response", payload: str = "payload", user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Posts (see _OUT) and rejects (response, item, reason) of a stock board: titles and bodies are joined, the time is text."""
    items, bad = _items(responses, key, payload, ("$.data.list", "$.list"), "list")
    v = F.col("v")
    title, body = _text(v, "post_title"), F.coalesce(_text(v, "post_content"), F.lit(""))
    content = F.trim(F.when(title.isNotNull(), F.concat(title, F.lit("\n"), body)).otherwise(body), F.lit(" \t\r\n"))
    post = _text(v, "post_id", "id")
    owner = responses.select(F.col(key).alias("response"), F.col(user).cast("string").alias("_user")) if user in responses.columns else None
    reason = F.when(post.isNull(), "no identifier").when(content == "", "no text")
    row = {
        "platform": F.lit("guba"), "platform_id": post, "account_name": F.coalesce(_text(v, "user_nickname"), F.nullif("account", F.lit(""))),
        "source_url": F.concat(F.lit("https://guba.eastmoney.com/news,"), F.col("_user") if owner is not None else F.lit(""), F.lit(","), post, F.lit(".html")),
        "published_at": F.try_to_timestamp(F.try_variant_get(v, "$.post_publish_time", "string")), "content": content, "meta": _meta(v, post_id="post_id", post_type="post_type", post_source_id="post_source_id", title="post_title"),
    }
    return _split(items.join(owner, "response") if owner is not None else items, bad, reason, row)


def timeline_posts(responses: DataFrame, key: str = "response", payload: str = "payload", user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Posts and rejects of a timeline: text or description, the identifier or the end of `target`, the time in milliseconds."""
    items, bad = _items(responses, key, payload, ("$.list",), "list")
    v = F.col("v")
    content, target = _text(v, "text", "description"), F.trim(F.coalesce(F.try_variant_get(v, "$.target", "string"), F.lit("")))
    status = F.coalesce(_text(v, "id"), F.nullif(F.element_at(F.split(F.regexp_replace(target, "/+$", ""), "/"), -1), F.lit("")))
    owner = responses.select(F.col(key).alias("response"), F.col(user).cast("string").alias("_user")) if user in responses.columns else None
    reason = F.when(content.isNull(), "no text").when(status.isNull(), "no identifier")
    row = {
        "platform": F.lit("xueqiu"), "platform_id": status, "account_name": F.nullif("account", F.lit("")),
        "source_url": F.when(target != "", F.concat(F.lit("https://xueqiu.com"), target)).otherwise(F.concat(F.lit("https://xueqiu.com/u/"), F.col("_user") if owner is not None else F.lit(""))),
        "published_at": F.timestamp_millis(F.try_variant_get(v, "$.created_at", "bigint")), "content": content,
        "meta": _meta(v, status_id="id", target="target", reply_count="reply_count", retweet_count="retweet_count", like_count="like_count"),
    }
    return _split(items.join(owner, "response") if owner is not None else items, bad, reason, row)
