"""Extraction: patterns, social profiles and wallets from text columns, and chat exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tagged, words_of

#: Profile URLs by platform.
SOCIAL = {
    "Facebook": r"https?://(?:www\.)?facebook\.com/([^/?]+)",
    "YouTube": r"https?://(?:www\.)?youtube\.com/(?:user|channel)/([^/?]+)",
    "Instagram": r"https?://(?:www\.)?instagram\.com/(@?[\w.-]+)",
    "TikTok": r"https?://(?:www\.)?tiktok\.com/(@?[\w.-]+)",
    "LinkedIn": r"https?://(?:www\.)?linkedin\.com/in/([\w-]+)",
    "Telegram": r"https?://(?:www\.)?t\.me/([\w-]+)",
    "Douyin": r"https?://(?:www\.)?douyin\.com/(@?[\w.-]+)",
    "QQ": r"https?://user\.qzone\.qq\.com/(\d+)",
    "Snapchat": r"https?://(?:www\.)?snapchat\.com/add/([\w.-]+)",
    "Pinterest": r"https?://(?:www\.)?pinterest\.com/([^/?]+)",
    "Reddit": r"https?://(?:www\.)?reddit\.com/user/([\w-]+)",
    "Twitter": r"https?://(?:www\.)?twitter\.com/([\w-]+)",
    "imo": r"https?://(?:www\.)?imo\.im/([\w.-]+)",
    "Line": r"https?://(?:www\.)?line\.me/R/ti/p/([\w.-]+)",
    "Vevo": r"https?://(?:www\.)?vevo\.com/([^/?]+)",
    "Discord": r"https?://(?:www\.)?discord(?:app)?\.com/([\w.-]+)",
    "Twitch": r"https?://(?:www\.)?twitch\.tv/([\w.-]+)",
    "VK": r"https?://(?:www\.)?vk\.com/([\w.-]+)",
    "Parler": r"https?://(?:www\.)?parler\.com/profile/([\w.-]+)",
    "Gab": r"https?://(?:www\.)?gab\.com/([\w.-]+)",
    "Odysee": r"https?://(?:www\.)?odysee\.com/(@?[\w.-]+)",
    "LBRY": r"https?://(?:www\.)?lbry\.tv/(@?[\w.-]+)",
    "Truth Social": r"https?://(?:www\.)?truthsocial\.com/user/([\w.-]+)",
    "BitChute": r"https?://(?:www\.)?bitchute\.com/channel/([\w.-]+)",
    "Gettr": r"https?://(?:www\.)?gettr\.com/user/([\w.-]+)",
    "Rumble": r"https?://(?:www\.)?rumble\.com/([\w.-]+)",
    "Locals": r"https?://(?:www\.)?locals\.com/([\w.-]+)",
    "Apple Podcasts": r"https?://(?:podcasts\.apple\.com|itunes\.apple\.com)/([^/?]+)",
    "iHeartRadio": r"https?://(?:www\.)?iheart\.com/(?:[^/]+/)?(?:podcast|show)/([\w-]+)",
    "Google Play": r"https?://play\.google\.com/store/apps/details\?id=([\w.]+)",
}
#: Wallet addresses by currency.
WALLETS = {
    "Bitcoin": r"\b(?:bc1[a-z0-9]{25,87}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "Ethereum": r"\b0x[a-fA-F0-9]{40}\b",
    "Litecoin": r"\b[LM3][a-km-zA-HJ-NP-Z1-9]{26,33}\b",
    "Dogecoin": r"\bD[5-9A-HJ-NP-U][1-9A-HJ-NP-Za-km-z]{32}\b",
    "Monero": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
    "Ripple": r"\br[0-9A-Za-z]{24,34}\b",
    "Solana": r"\b[1-9A-HJ-NP-Za-km-z]{43,44}\b",
    "Cardano": r"\baddr1[0-9a-z]{58}\b",
}


def pattern_matches(text: Column, pattern: str) -> Column:
    """All matches: the whole match without groups, the group if there is one, else the first group that isn't empty (all empty: joined by ``::``)."""
    groups = re.compile(pattern).groups
    if groups < 2:
        return words_of(text, pattern, groups)
    each = [words_of(text, pattern, k + 1) for k in range(groups)]
    row = F.arrays_zip(*(e.alias(f"g{k}") for k, e in enumerate(each)))
    return F.transform(row, lambda r: F.coalesce(*(F.nullif(r[f"g{k}"], F.lit("")) for k in range(groups)), F.lit("::" * (groups - 1))))


def normal_handle(c: Column) -> Column:
    h = F.regexp_replace(F.trim(F.split_part(F.trim(c), F.lit("?"), F.lit(1))), r"^/+|/+$", "")
    return F.regexp_replace(h, r"^@", "")


def social_profiles(text: Column, platform: str | None = None, strict: bool = False) -> Column:
    """Array of (platform, handle). ``strict`` ends handles at white space too."""
    chosen = {platform: SOCIAL[platform]} if platform in SOCIAL else SOCIAL
    some = F.contains(F.lower(text), F.lit("http"))

    def of(p: str, pattern: str) -> Column:
        pattern = pattern.replace("[^/?]", r"[^/?\s]") if strict else pattern
        found = F.transform(words_of(text, "(?iU)" + pattern, 1), lambda h: F.struct(F.lit(p).alias("platform"), normal_handle(h).alias("handle")))
        return F.filter(found, lambda x: x["handle"] != "")

    found = F.flatten(F.array(*(of(p, x) for p, x in chosen.items())))
    return F.when(some, found).otherwise(F.array().cast("array<struct<platform:string,handle:string>>"))


def social_matches(text: Column, platform: str | None = None) -> Column:
    return F.transform(social_profiles(text, platform), lambda x: F.concat(x["platform"], F.lit(":"), x["handle"]))


def wallets(text: Column, strict_case: bool = False) -> Column:
    """Array of (currency, wallet). Cases don't matter unless ``strict_case``, as in the tool this stands in for."""
    flag = "" if strict_case else "(?i)"
    of = lambda name, pattern: F.transform(words_of(text, flag + pattern), lambda w: F.struct(F.lit(name).alias("currency"), w.alias("wallet")))
    return F.flatten(F.array(*(of(n, p) for n, p in WALLETS.items())))


def counted(df: DataFrame, items: Column, *names: str) -> DataFrame:
    """How often each item of an array column occurs; fields of structs become columns."""
    e = df.select(F.explode(items).alias("i"))
    e = e.select(*(F.col(f"i.{n}").alias(n) for n in names)) if len(names) > 1 else e.select(F.col("i").alias(names[0]))
    return e.groupBy(*names).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *names)


def tabular_rows(df: DataFrame, text: str, row_index: str, pattern: str | None = None) -> DataFrame:
    c = F.coalesce(F.col(text), F.lit(""))
    m = pattern_matches(c, pattern) if pattern else F.array().cast("array<string>")
    w = F.transform(wallets(c), lambda x: F.concat(x["currency"], F.lit(":"), x["wallet"]))
    base = df.select(F.col(row_index).alias("row_index"), F.col(text), m.alias("_m"), social_matches(c).alias("_s"), w.alias("_w"))
    joined = lambda a: F.array_join(a, "; ")
    return base.select(
        "row_index", text, joined("_m").alias("matches"), F.size("_m").cast("long").alias("match_count"), joined("_s").alias("social_profiles"), F.size("_s").cast("long").alias("social_profile_count"),
        joined("_w").alias("crypto_wallets"), F.size("_w").cast("long").alias("crypto_wallet_count"),
    )


def tabular_tables(df: DataFrame, text: str, pattern: str) -> dict[str, DataFrame]:
    c = F.coalesce(F.col(text), F.lit(""))
    return {"MATCHES": counted(df, pattern_matches(c, pattern), "pattern"), "SOCIAL_PROFILES": counted(df, social_profiles(c), "platform", "handle"), "CRYPTO_WALLETS": counted(df, wallets(c), "currency", "wallet")}


def sheet(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns, by count (largest first), then by the others."""
    order = [F.desc("count")] if "count" in columns else []
    return df.select(*columns).orderBy(*order, *(c for c in columns if c != "count"))


#: A message's text is a string or a list of strings and typed parts.
PARTS = "array<struct<type:string,text:string,href:string>>"


def telegram_messages(raw: DataFrame) -> DataFrame:
    """``name, channel_id, filename, forwarded_from, full_text, hashtags, mentions, links`` of exports read by the Telegram source.

    ``raw``: ``name, id, filename, messages array<struct<forwarded_from, text>>`` with ``text`` as JSON.
    """
    m = raw.select("name", F.col("id").cast("string").alias("channel_id"), "filename", F.explode("messages").alias("m")).select("name", "channel_id", "filename", F.col("m.forwarded_from").alias("forwarded_from"), F.col("m.text").alias("text"))
    as_list = F.when(F.trim("text").startswith("["), F.from_json("text", "array<string>"))
    part = lambda x: F.when(x.startswith("{"), F.from_json(x, "struct<type:string,text:string,href:string>")).otherwise(F.struct(F.lit("plain").alias("type"), x.alias("text"), F.lit(None).cast("string").alias("href")))
    parts = F.coalesce(F.transform(as_list, part), F.array(F.struct(F.lit("plain").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("href"))))
    m = m.withColumn("parts", parts)
    of = lambda *kinds: F.transform(F.filter("parts", lambda p: p["type"].isin(*kinds)), lambda p: p["text"])
    linked = F.transform(F.filter("parts", lambda p: p["type"].isin("link", "text_link")), lambda p: F.coalesce(F.nullif(p["href"], F.lit("")), p["text"]))
    return m.select("name", "channel_id", "filename", "forwarded_from", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("full_text"), of("hashtag").alias("hashtags"), of("mention").alias("mentions"), linked.alias("links"))


def telegram_counts(messages: DataFrame, pattern: str | None = None) -> DataFrame:
    """``name, channel_id, filename, kind, value, count`` for matches, mentions, hashtags, links, forwarded and wallets."""
    none = F.array().cast("array<string>")
    w = F.transform(wallets(F.col("full_text")), lambda x: F.concat(x["currency"], F.lit(":"), x["wallet"]))
    kinds = {"match": pattern_matches(F.col("full_text"), pattern) if pattern else none, "mention": F.col("mentions"), "hashtag": F.col("hashtags"), "link": F.col("links"), "forwarded": F.when(F.col("forwarded_from").isNotNull(), F.array("forwarded_from")).otherwise(none), "wallet": w}
    stacked = F.flatten(F.array(*(tagged(a, k) for k, a in kinds.items())))
    keys = ["name", "channel_id", "filename"]
    return messages.select(*keys, F.explode(stacked).alias("x")).groupBy(*keys, F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.count("*").alias("count")).orderBy(*keys, "kind", F.desc("count"), "value")


def telegram_summary(counts: DataFrame) -> DataFrame:
    """Totals per file, the forwarded ones included."""
    keys = ["name", "channel_id", "filename"]
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("count")).otherwise(0)).alias(f"{k}_total")
    return counts.groupBy(*keys).agg(*(total(k) for k in ("match", "mention", "hashtag", "link", "forwarded", "wallet"))).orderBy(*keys)
