"""Lexicon classification of captions, queries and candidate metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import rules as R
from .lexicon import Rules, all_hits, any_of, first_hit
from .text import blank, english_tokens, let, squash, strings, tokens


def infer_tone(text: Column, rules: Rules = R.TONE_RULES) -> Column:

    def made(v: Column) -> Column:
        large = any_of(v, R.RU_LARGE_COUNT) | v.rlike(r"(?U)\b\d{3,}\b")
        tragic = (any_of(v, R.RU_LIFE_LOSS) & (large | any_of(v, R.RU_LOSS_VERB))) | (
            any_of(v, R.EN_LIFE_LOSS) & (any_of(v, R.EN_MASS) | any_of(v, R.EN_LOSS_VERB))
        )
        return (
            F.when(tragic, "tragic")
            .when(any_of(v, R.VIOLENT_ACTION), "violent")
            .when(any_of(v, R.MILITARY_ACTION), "tense")
            .otherwise(first_hit(v, rules, "neutral"))
        )

    return let(F.lower(blank(text)), made)


def mood(text: Column, rules: Rules = R.MOOD_RULES) -> Column:
    return first_hit(F.lower(blank(text)), rules, "neutral")


def visual_mode(caption: Column, index: Column, duration_ms: Column, memes=R.MEME_STEMS, videos=R.VIDEO_STEMS) -> Column:

    def made(v: Column) -> Column:
        return (
            F.when(any_of(v, memes), "meme")
            .when(any_of(v, videos), "video")
            .when((index > 0) & (index % 4 == 3) & (duration_ms >= 1400), "video")
            .otherwise("image")
        )

    return let(F.lower(blank(caption)), made)


def source_mode(caption: Column, context: Column, mode: Column, history=R.HISTORY_STEMS) -> Column:
    archival = F.contains(F.lower(blank(context)), F.lit("historical archival"))
    return (
        F.when(mode == "meme", "meme_library")
        .when(archival & any_of(F.lower(blank(caption)), history), "historical_archive")
        .when(mode == "video", "stock_video")
        .otherwise("generic_image")
    )


def motion_preset(caption: Column, index: Column, mode: Column, pullback=R.PULLBACK_STEMS, dramatic=R.DRAMATIC_STEMS) -> Column:

    def made(v: Column) -> Column:
        return (
            F.when(mode == "meme", "none")
            .when(any_of(v, pullback), "pull_back")
            .when(any_of(v, dramatic), "dramatic_push")
            .when(index % 5 == 2, "reveal_right")
            .when(index % 5 == 4, "reveal_left")
            .when(mode == "image", "slow_push")
            .otherwise("micro_push")
        )

    return let(F.lower(blank(caption)), made)


def explicit_entities(text: Column) -> Column:

    def made(v: Column) -> Column:
        hong = any_of(v, R.HONG)
        exam = ~hong & F.contains(v, F.lit("экзам")) & any_of(v, ("импер", "чиновник", "гос"))
        return F.array_compact(
            F.array(
                F.when(hong, "Hong Xiuquan"),
                F.when(F.contains(v, F.lit("тайпин")), "Taiping Rebellion"),
                F.when(exam, "Imperial examination"),
                F.when(any_of(v, R.WORLD_WAR_ONE), "World War I"),
            )
        )

    return let(F.lower(blank(text)), made)


def _names_time(text: Column, pattern: str) -> Column:
    """Does one of the era or century patterns hit? All start with 1, 2 or x, so other places are not tried."""
    return text.rlike(f"(?=[12x])(?U)(?:{pattern})")


def detect_era(text: Column) -> Column:
    """Era named by a year or a century word; empty when there is none."""

    def named(t: Column) -> Column:
        out = F.when(_names_time(t, R.ERA_PATTERNS[0][1]), R.ERA_PATTERNS[0][0])
        for label, pattern in R.ERA_PATTERNS[1:]:
            out = out.when(_names_time(t, pattern), label)
        return out.otherwise("")

    return let(text, named)


def explicit_century(text: Column) -> Column:
    out = F.when(text.rlike("(?U)" + R.CENTURY_PATTERNS[0][1]), R.CENTURY_PATTERNS[0][0])
    for label, pattern in R.CENTURY_PATTERNS[1:]:
        out = out.when(text.rlike("(?U)" + pattern), label)
    return out


def semantic_lock(caption: Column, entities: Column | None = None) -> Column:
    """Struct of lock flag, entities, context and fallback text. ``entities`` may hold the ``explicit_entities`` of the caption."""

    def context(v: Column) -> Column:
        era = let(detect_era(v), lambda e: F.when(~e.isin("", "21st century modern"), e))
        return F.array_compact(F.array(F.when(any_of(v, R.CHINA), "China"), F.when(any_of(v, R.QING), "Qing dynasty"), era))

    none = F.array().cast("array<string>")

    def build(p: Column) -> Column:
        locked = F.size(p.e) > 0
        return F.struct(
            locked.alias("locked"),
            p.e.alias("entities"),
            F.when(locked, p.c).otherwise(none).alias("context"),
            F.when(
                locked, F.array_join(F.concat(p.e, p.c, F.array(F.lit("archival illustration"))), " ")
            ).alias("fallback"),
        )

    e = explicit_entities(caption) if entities is None else entities
    # the context of captions without entities is not used
    c = F.when(F.size(e) > 0, let(F.lower(blank(caption)), context)).otherwise(none)
    return let(F.struct(e.alias("e"), c.alias("c")), build)


#: Words of the longest needle that story context looks for.
CONTEXT_WORDS = 1 + max(
    len(re.findall(r" |\\s", needle))
    for needle in (*(n for _, ns in R.COUNTRY_RULES for n in ns), *(p for _, p in R.ERA_PATTERNS), *R.HISTORY_STEMS, *R.TAIPING_STORY, *R.QING)
)


def context_parts(text: Column) -> Column:
    """Rule hits of a text that matter for the story context, as a set of labels.

    The union of these sets over the texts of a plan gives the same hits as the
    joined plan text, so plans of any size aggregate in parallel.
    """

    def made(v: Column) -> Column:
        return F.array_compact(
            F.array(
                *[F.when(any_of(v, ns), F.lit(label)) for label, ns in R.COUNTRY_RULES],
                *[F.when(_names_time(v, p), F.lit(label)) for label, p in R.ERA_PATTERNS],
                F.when(any_of(v, R.HISTORY_STEMS), F.lit("history")),
            )
        )

    return let(F.lower(blank(text)), made)


def context_from_parts(parts: Column) -> Column:
    """Story context phrase built from the label set of a plan."""
    countries = [label for label, _ in R.COUNTRY_RULES]
    eras = [label for label, _ in R.ERA_PATTERNS]
    era = F.coalesce(*[F.when(F.array_contains(parts, e), e) for e in eras])
    archival = era.isNotNull() | F.array_contains(parts, "history")
    pieces = F.array_compact(
        F.array(
            *[F.when(F.array_contains(parts, c), F.lit(c)) for c in countries],
            era,
            F.when(archival, "historical archival"),
            F.when(F.array_contains(parts, "China Chinese") & (era == "19th century"), "Qing dynasty"),
            F.when(F.array_contains(parts, "Taiping Rebellion"), "1850s China"),
        )
    )
    return F.array_join(pieces, " ")


def setting_context(context: Column) -> Column:
    return squash(F.regexp_replace(blank(context), "(?i)Hong Xiuquan|Taiping Rebellion", " "))


def soft_context_parts(text: Column) -> Column:

    def made(v: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(any_of(v, R.TAIPING_STORY), "story"),
                F.when(any_of(v, ("китай", "china", "chinese")), "china"),
                F.when(any_of(v, R.QING), "qing"),
            )
        )

    return let(F.lower(blank(text)), made)


def soft_context_from_parts(parts: Column) -> Column:
    story = F.array_contains(parts, "story")
    return F.concat_ws(
        ", ",
        F.when(story, "19th-century China, Taiping Rebellion era"),
        F.when(~story & F.array_contains(parts, "china"), "China"),
        F.when(F.array_contains(parts, "qing"), "Qing dynasty"),
    )


def visual_hints(text: Column, rules: Rules = R.HINT_RULES) -> Column:
    return all_hits(F.lower(blank(text)), rules)


def beat_role(
    text: Column, casualty=R.ROLE_CASUALTY, battle=R.ROLE_BATTLE, army=R.ROLE_ARMY, awaken=R.ROLE_AWAKEN,
    religious=R.ROLE_RELIGIOUS, belief=R.ROLE_BELIEF, dream=R.ROLE_DREAM, reaction=R.ROLE_REACTION,
) -> Column:

    def made(v: Column) -> Column:
        sacred, asleep = any_of(v, religious), any_of(v, dream)
        return (
            F.when(any_of(v, casualty), "aftermath")
            .when(any_of(v, battle), "battle")
            .when(any_of(v, army), "army")
            .when(any_of(v, awaken), "awakening")
            .when(sacred & (any_of(v, belief) | asleep), "revelation")
            .when(asleep, "vision")
            .when(any_of(v, reaction), "reaction")
            .otherwise("")
        )

    return let(F.lower(blank(text)), made)


def reaction_prompt(caption: Column, query: Column, rules=R.REACTION_RULES) -> Column:
    def made(strength: int, prompt: str) -> Column:
        return F.struct(F.lit(strength).alias("strength"), F.lit(prompt).alias("prompt"))

    def strongest(v: Column) -> Column:
        out = F.when(any_of(v, rules[0][1]), made(rules[0][0], rules[0][2]))
        for strength, needles, prompt in rules[1:]:
            out = out.when(any_of(v, needles), made(strength, prompt))
        return out.otherwise(made(0, ""))

    return let(F.lower(F.concat(blank(caption), F.lit(" "), blank(query))), strongest)


def reaction_family(text: Column) -> Column:
    v = F.lower(blank(text))
    slug = F.substring(F.regexp_replace(F.regexp_replace(v, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return first_hit(v, R.REACTION_FAMILIES, F.when(slug == "", "reaction").otherwise(slug))


def named_events(text: Column) -> Column:
    return all_hits(F.lower(blank(text)), R.EVENT_NAMES)


def named_countries(text: Column) -> Column:
    return all_hits(F.lower(blank(text)), R.COUNTRY_NAMES)


def metadata_conflict(locked: Column, scene_text: Column, meta_text: Column) -> Column:
    """Reason a candidate contradicts a locked scene; null when it does not."""

    def apart(a: Column, b: Column) -> Column:
        return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)

    s, m = F.lower(blank(scene_text)), F.lower(blank(meta_text))
    return F.when(
        locked,
        F.when(apart(named_events(s), named_events(m)), "wrong event/war in candidate metadata")
        .when(apart(named_countries(s), named_countries(m)), "wrong country in candidate metadata")
        .when(explicit_century(s) != explicit_century(m), "wrong century in candidate metadata"),
    )


def local_required_context(context: Column, caption: Column) -> Column:
    """Keep only the required contexts that this caption names itself."""
    v = F.lower(blank(caption))
    era = {label[:4]: v.rlike("(?U)" + pattern) for label, pattern in R.ERA_PATTERNS}

    def named(c: Column) -> Column:
        low = F.lower(c)
        return (
            F.when(F.contains(low, F.lit("china")) | F.contains(low, F.lit("chinese")), any_of(v, R.CHINA))
            .when(F.contains(low, F.lit("qing")), any_of(v, ("цин", "qing")))
            .when(F.contains(low, F.lit("19th century")), era["19th"])
            .when(F.contains(low, F.lit("20th century")), era["20th"])
            .when(F.contains(low, F.lit("21st century")), era["21st"])
            .otherwise((F.size(tokens(c)) > 0) & (F.size(F.array_except(tokens(c), tokens(v))) == 0))
        )

    return F.array_distinct(F.filter(context, named))


def locally_historical(text: Column) -> Column:
    return any_of(F.lower(blank(text)), R.HISTORY_STEMS) | (F.size(explicit_entities(text)) > 0)


def christian_reference(text: Column) -> Column:
    return any_of(F.lower(blank(text)), R.CHRISTIAN)


def army_action(text: Column) -> Column:
    return any_of(F.lower(blank(text)), R.ARMY_ACTION)


def taiping_story(text: Column) -> Column:
    return any_of(F.lower(blank(text)), R.TAIPING_STORY)


def query_tags(text: Column) -> Column:
    return all_hits(F.lower(blank(text)), R.QUERY_TAGS)


def query_matches_intent(query: Column, baseline: Column, tags: Column | None = None) -> Column:
    """Does a proposed query stay on the subject of the rule queries (first three)? ``tags`` may hold the ``query_tags`` of the query."""
    base = F.lower(F.array_join(F.slice(baseline, 1, 3), " "))
    tags = query_tags(query) if tags is None else tags

    def near(words: Column) -> Column:
        shared = F.size(F.array_intersect(english_tokens(base), words))
        return (shared >= 2) | ((shared == 1) & (F.size(words) <= 7))

    wanted = query_tags(base)
    return F.arrays_overlap(wanted, tags) | let(F.array_distinct(english_tokens(query)), near) | (F.size(wanted) == 0)


def is_action_query(text: Column) -> Column:
    return any_of(F.lower(text), R.ACTION_VERBS)


def tone_compatible(a: Column, b: Column) -> Column:
    return (
        F.when(a.isin(*R.DARK_TONES), b.isin(*R.DARK_TONES, "emotional", "mysterious", "neutral"))
        .when(a.isin(*R.LIGHT_TONES), b.isin(*R.LIGHT_TONES, "neutral", "emotional"))
        .otherwise(True)
    )


def lower_all(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(x))


def lock_compatible(entities: Column, context: Column, other_entities: Column, other_context: Column) -> Column:
    def meets(a: Column, b: Column) -> Column:
        return (F.size(a) == 0) | F.arrays_overlap(lower_all(a), lower_all(b))

    return meets(entities, other_entities) & meets(context, other_context)


def context_compatible(context: Column, other_text: Column) -> Column:
    return (F.size(context) == 0) | F.exists(context, lambda c: F.contains(F.lower(other_text), F.lower(c)))


def source_allowed(locked: Column, mode: Column, source: Column, kind: Column) -> Column:
    archive = source.isin("commons", "openverse") & (kind == "image")
    return (
        F.when(locked | (mode == "historical_archive"), archive)
        .when(
            mode == "stock_video",
            ((kind == "video") & source.isin("pexels", "pixabay"))
            | ((kind == "image") & source.isin("commons", "openverse", "pexels", "pixabay")),
        )
        .when(mode == "meme_library", source == "local_meme")
        .when(mode == "generic_image", kind == "image")
        .otherwise(True)
    )


def bad_title(title: Column, description: Column) -> Column:
    """First unwanted whole-word term of a title and description, in list order; null when clean."""

    def found(hay: Column) -> Column:
        # The plain substring test spares most texts the pattern.
        whole = lambda t: F.contains(hay, F.lit(t)) & hay.rlike(rf"(?U)(?<!\w){t}(?!\w)")
        return F.coalesce(*[F.when(whole(t), F.lit(t)) for t in R.BAD_TITLE_TERMS])

    return let(F.lower(F.concat_ws(" ", blank(title), blank(description))), found)


def tone_hint(tone: Column) -> Column:
    out = F.lit("")
    for name, hint in R.TONE_HINTS.items():
        out = F.when(tone == name, hint).otherwise(out)
    return out
