"""Text gates, normal forms and mined names, as column expressions (SC1-SC7, SC10-SC18, SC22-SC29, SC31, F15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker phrases, word lists and limits that results depend on.
LLM_META_MARKERS = ("operations", "chain of thought", "let me think", "final answer:", "empty operations", "as requested", "here is the json", "based on the messages")
REFUSAL_MARKERS = ("i cannot", "i can't", "i apologize", "i'm sorry", "as an ai", "i'm unable", "against my guidelines")
EPHEMERAL_CLAIMS = ("expressed a belief", "heard that", "claims that", "read online", "someone said", "rumor")
DURABLE_MARKERS = ("my name is", "call me", "i live", "i work", "i study", "allergic", "birthday", "pronouns", "partner", "spouse", "husband", "wife", "moved to", "graduated", "works at", "studies")
KINSHIP_TERMS = ("brother", "sister", "mom", "mother", "dad", "father", "cousin", "uncle", "aunt", "grandma", "grandpa", "friend", "roommate", "boss", "wife", "husband", "partner", "son", "daughter", "kid", "dog", "cat")
TRAILING_NOISE = ("and", "but", "or", "so", "the", "a", "an", "is", "it", "to", "too", "also", "then")
NEGATIVE_VERBS = ("dislikes", "hates", "called_out", "argues_with", "distrusts", "feuds_with", "disapproves_of", "avoids")
POSITIVE_VERBS = ("likes", "loves", "enjoys", "prefers", "friends_with", "friend_of", "supports", "admires", "collaborates_with", "teammate_of", "fan_of")
CATEGORIES = ("personal", "preferences", "interests", "professional", "relationships", "goals", "experiences", "personality", "culture", "rules", "general")
ENTITY_KINDS = ("person", "place", "concept", "org")
ALIAS_RANKS = {"discord_username": 100, "subject_username": 95, "real_name": 85, "display_name": 70, "mention": 60, "backfill": 50, "entity_tag": 40}
ALIAS_WEIGHTS = {"discord_username": 1.0, "subject_username": 0.95, "real_name": 0.85, "display_name": 0.7, "mention": 0.6, "backfill": 0.5, "entity_tag": 0.4}
HYGIENE = ("empty", "too_long", "too_short", "refusal", "llm_meta", "snowflake_in_text", "mention_tag_in_text", "question", "rant_denial")
MAX_FACT_CHARS = 400
MIN_FACT_CHARS = 12

URL = r"(?i)https?://\S+|www\.\S+"
NAME = r"([a-z][a-z0-9'.-]*(?: [a-z][a-z0-9'.-]*)?)"
QUESTION = r"(?iU)^(?:(?:who|what|when|where|why|how)\b|(?:do|does|did|is|are|was|were|can|could|should|would|has|have|had)\s+(?:i|you|he|she|it|we|they|there|this|that)\b)"
SHARE = r"(?U)\b(shared|posted|sent|uploaded|linked|dropped)\b"
MEDIA = r"(?U)\b(link|video|gif|image|photo|meme|file|youtube|tiktok|tenor)s?\b"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(haystack: Column, needles: tuple[str, ...]) -> Column:
    """Whether a string holds one of a few fixed substrings."""
    found = F.lit(False)
    for needle in needles:
        found = found | haystack.contains(needle)
    return found


def normalize(text: Column) -> Column:
    """SC1: lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(stripped(F.lower(text)), r"(?U)\s+", " ")


def slug(text: Column) -> Column:
    """SC2: runs outside a-z0-9 as one hyphen, none at the ends; `unknown` if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "unknown").otherwise(made)


def is_valid_alias(norm: Column) -> Column:
    """SC3."""
    return (F.length(norm) >= 2) & (F.length(norm) <= 64) & ~norm.rlike(r"^[0-9]{9,}$")


def weight_for_source(source: Column, surface: Column | None = None) -> Column:
    """SC4: the source's base weight; a well-formed username has .95 at least."""
    base = F.element_at(F.create_map(*(F.lit(x) for pair in ALIAS_WEIGHTS.items() for x in pair)), source)
    if surface is None:
        return base
    formed = (source == "discord_username") & F.lower(stripped(surface)).rlike(r"^[a-z0-9._-]{2,32}$")
    return F.when(formed, F.greatest(base, F.lit(0.95))).otherwise(base)


def rank_for_source(source: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ALIAS_RANKS.items() for x in pair)), source)


def _names(text: Column, pattern: str, weight: float) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)" + pattern), F.lit(1))

    def kept(name: Column) -> Column:
        last = F.element_at(F.split(name, " "), -1)
        noise = F.contains(name, F.lit(" ")) & F.lower(last).isin(*TRAILING_NOISE)
        return F.struct(F.when(noise, F.element_at(F.split(name, " "), 1)).otherwise(name).alias("name"), F.lit(weight).alias("weight"))

    return F.transform(found, kept)


def self_names(text: Column) -> Column:
    """SC5: names an author gives as their own, with weights, pattern by pattern."""
    return F.concat(
        _names(text, r"\bmy name(?:'s| is) " + NAME, 0.88),
        _names(text, r"\bcall me " + NAME, 0.86),
        _names(text, r"\bi go by " + NAME, 0.85),
    )


def stated_names(text: Column) -> Column:
    """SC6: names stated of the subject of a fact."""
    return _names(text, r"\b(?:real |full )?name is " + NAME, 0.85)


def is_third_party_name(text: Column, name: Column) -> Column:
    """SC7: whether a name in a text is that of somebody else."""
    lowered, own = F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lower(name)
    kin = F.concat(F.lit(r"(?U)\b(?:" + "|".join(KINSHIP_TERMS) + r")\b[^.]{0,24}\b\Q"), F.regexp_replace(own, r"\\E", ""), F.lit(r"\E\b"))
    return F.contains(lowered, F.concat(F.lit("'s "), own)) | F.regexp_like(lowered, kin) | F.contains(lowered, F.concat(F.lit("someone named "), own))


def hygiene(text: Column, reasons: tuple[str, ...] = HYGIENE) -> Column:
    """SC10: why a fact's text is not fit to store, or null; fewer reasons may be asked for, in the same order."""
    low, bare, size = F.lower(text), stripped(text), F.length(text)
    meta = sum((F.when(low.contains(m), 1).otherwise(0) for m in LLM_META_MARKERS), F.lit(0))
    rules = {
        "empty": text.isNull() | (bare == ""),
        "too_long": size > MAX_FACT_CHARS,
        "too_short": F.length(normalize(text)) < MIN_FACT_CHARS,
        "refusal": any_of(low, REFUSAL_MARKERS),
        "llm_meta": (meta >= 2) | ((meta >= 1) & (size > 200)),
        "snowflake_in_text": text.rlike(r"(?U)\b\d{15,25}\b"),
        "mention_tag_in_text": text.rlike(r"<@!?&?[0-9]+>"),
        "question": bare.endswith("?") | bare.rlike(QUESTION),
        "rant_denial": low.rlike(r"(?U)\b(no no no|i don'?t|stop it)\b"),
    }
    return F.coalesce(*(F.when(rules[r], r) for r in HYGIENE if r in reasons))


def share(text: Column) -> Column:
    """SC11: why a text is no more than a shared link or medium, or null."""
    low = F.lower(text)
    return (
        F.when(stripped(F.regexp_replace(text, URL, " ")) == "", "bare_link")
        .when(low.rlike(SHARE) & low.rlike(MEDIA), "media_share")
        .when(low.rlike(SHARE) & text.rlike(URL), "link_share")
    )


def confidence_gate(confidence: Column, text: Column, least: float = 0.55) -> Column:
    """SC12: why a confidence does not suffice, or null; hearsay needs more, and a durable marker."""
    low = F.lower(text)
    hearsay = any_of(low, EPHEMERAL_CLAIMS)
    return F.when(hearsay & ~((confidence >= 0.75) & any_of(low, DURABLE_MARKERS)), "ephemeral_claim").when(~hearsay & (confidence < least), "below_min_confidence")


def frame_gate(text: Column) -> Column:
    """SC13: rejects a fact that begins in the first person."""
    return F.when(stripped(text).rlike(r"(?iU)^(?:i|my|me|we|our)\b"), "unbound_speaker")


def polarity(verb: Column) -> Column:
    """SC15."""
    name = F.replace(F.lower(stripped(verb)), F.lit(" "), F.lit("_"))
    return F.when(name.isin(*NEGATIVE_VERBS), "negative").when(name.isin(*POSITIVE_VERBS), "positive").otherwise("neutral")


def snippet(text: Column, most: int = 280, collapse: bool = False) -> Column:
    """SC16: trimmed, line ends (or all runs of white space) as spaces, cut off with an ellipsis."""
    line = stripped(F.regexp_replace(text, r"(?U)\s+", " ")) if collapse else F.regexp_replace(stripped(text), "\n", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def tokens(text: Column) -> Column:
    """SC17: estimated tokens, a quarter of the length, rounded up."""
    return F.ceil(F.length(text) / 4)


def message_url(guild: Column, channel: Column, message: Column) -> Column:
    """SC18."""
    return F.concat_ws("/", F.lit("https://discord.com/channels"), guild, F.coalesce(F.nullif(channel, F.lit("")), F.lit("0")), message)


def category(value: Column) -> Column:
    """SC22: an unknown category is general."""
    return F.when(F.lower(value).isin(*CATEGORIES), F.lower(value)).otherwise("general")


def entity_kind(value: Column) -> Column:
    """SC22: an unknown kind of entity is a concept."""
    return F.when(F.lower(value).isin(*ENTITY_KINDS), F.lower(value)).otherwise("concept")


def bound_names(text: Column, names: Column) -> Column:
    """SC23: tokens p0, p1, ... replaced by the names in a map; unknown ones stay."""
    entries = F.array_sort(F.map_entries(names), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(entries, text, lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?U)\b"), e["key"], F.lit(r"\b")), e["value"]))


def content_id(*parts: Column) -> Column:
    """SC24, SC25: a deterministic id, the SHA-256 of its parts, in place of a random one."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def horizon_days(text: Column, short: int = 7) -> Column:
    """SC26: days that a text's explicit horizon is good for, or null."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"(?U)\b(today|tonight)\b"), min(3, short))
        .when(low.rlike(r"(?U)\b(tomorrow|this weekend|next week|this week)\b"), short)
        .when(low.rlike(r"(?U)\b(this month|upcoming)\b"), 21)
    )


# Fixed value: phrases that a command to the memory holds.
COMMAND = r"(?iU)\b(remember|forget|don'?t remember|update|what do you know|what do you remember|recall|save this|purge your memories|never remember)\b"


def command(value: Column) -> Column:
    """SC27: what a message asks of the memory without a model's help: struct(action, target, confidence)."""
    low = stripped(F.lower(value))

    def answer(action: str, confidence: float, target: Column | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), (target if target is not None else F.lit("")).alias("target"), F.lit(confidence).alias("confidence"))

    after = F.regexp_replace(F.regexp_replace(value, r"(?s)\A.*?remember", ""), r"\A[ ,.:]+|[ ,.:]+\z", "")
    return (
        F.when(~value.rlike(COMMAND), answer("none", 0.0))
        .when(low.startswith("remember ") | low.contains(" remember that "), answer("remember", 0.6, after))
        .when(low.startswith("forget ") | low.contains(" forget that "), answer("forget", 0.6))
        .otherwise(answer("none", 0.3))
    )


def scan_words(text: Column, most: int = 16) -> Column:
    """SC28: the first words that an entity scan reads."""
    return F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, most)


def terms(text: Column) -> Column:
    """SC29: lower-cased terms between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def is_safe_url(url: Column) -> Column:
    """SC31: http(s) with a host, without white space, controls or angle brackets."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s<>\x00-\x1f\x7f]+[^\s<>\x00-\x1f\x7f]*$"), F.lit(False))


def is_snowflake(value: Column) -> Column:
    """F15."""
    return value.rlike(r"^[0-9]{15,25}$")
