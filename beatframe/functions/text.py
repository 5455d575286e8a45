"""Text and token functions as Spark column expressions."""

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

TOKEN = r"(?U)[\w-]+"

# Words that carry no search meaning.
STOPWORDS = (
    "а", "и", "но", "или", "в", "во", "на", "по", "к", "ко", "у", "из", "за", "с", "со", "от", "до", "для", "что", "это", "как", "же", "бы", "не",
    "ну", "я", "ты", "он", "она", "они", "мы", "вы", "мой", "моя", "его", "ее", "её", "the", "a", "an", "and", "or", "but", "to", "of", "in", "on",
    "for", "with", "this", "that", "it", "is", "are", "was", "were", "i", "you", "he", "she", "we",
)
# Tokens ignored when comparing English search intent.
GENERIC_ENGLISH = (
    "the", "and", "with", "from", "into", "photo", "image", "video", "documentary", "historical", "illustration", "footage", "scene", "visual",
    "broll", "roll",
)
# Tokens ignored in a query signature.
SIGNATURE_STOP = (
    "photo", "image", "video", "historical", "documentary", "illustration", "scene", "visual", "the", "and", "with",
)
# Period phrases removed from queries of unlocked scenes.
PERIOD_PHRASES = (
    r"19th[- ]century|1800s|Qing dynasty|Taiping Rebellion era|historical setting|period[- ]appropriate|"
    r"traditional Chinese (?:clothing|costume|setting)|in Qing China|Qing China"
)
# Retrieval boilerplate removed from action queries and from footage subjects.
ACTION_BOILERPLATE = (
    "real footage|documentary footage|vertical b roll|b roll|stock footage|photo illustration|"
    "visual metaphor|visual concept|metaphor"
)
STILL_BOILERPLATE = "painting|illustration|engraving|portrait|historical archive|archival|photo illustration"
# Fixed value: a spoken number with a unit.
QUANTITY = (
    r"\b\d+(?:[.,]\d+)?\s*(?:мл|л|литр(?:а|ов)?|кг|г|гр|см|мм|км|м|%|процент(?:а|ов)?|грн|руб(?:ля|лей)?|"
    r"доллар(?:а|ов)?|ml|kg|g|cm|mm|km)\b"
)
EDGE = r"^[ ,.;:\-]+|[ ,.;:\-]+$"
# Runs of white space that are not one plain space already: most spaces of a text need no replacement.
UNEVEN = r"(?U)[\s&&[^ ]]\s*| \s+"


def _starts(letters: str) -> str:
    """A look-ahead for phrases that start, in either case, with one of the letters.

    It spares most places of a text the word boundary and the phrases behind it, which are dear with (?iU)."""
    forms = {"s": "sSſ", "k": "kKK", "i": "iIıİ"}
    return "(?=[" + "".join(forms.get(c, c + c.upper() if c.isalpha() else c) for c in letters) + "])"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blank(col) -> Column:
    return F.coalesce(col, F.lit(""))


def filled(col: Column) -> Column:
    return F.coalesce(F.length(col) > 0, F.lit(False))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; null when there is none."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cols])


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, UNEVEN, " "))


def squash_edges(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, UNEVEN, " "), EDGE, "")


def split_words(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)\s+"), lambda x: x != "")


def tokens(col: Column) -> Column:
    """Distinct lower-cased word tokens longer than one character."""
    found = F.regexp_extract_all(F.lower(blank(col)), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def fx_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(col)), F.lit("[a-zа-яё0-9]+"), F.lit(0))


def english_tokens(col: Column) -> Column:
    found = F.regexp_extract_all(F.lower(blank(col)), F.lit("[a-z][a-z-]{2,}"), F.lit(0))
    return F.array_except(found, strings(*GENERIC_ENGLISH))


def useful_keywords(col: Column, limit: int) -> Column:
    bare = F.regexp_replace(F.regexp_replace(blank(col), r"(?U)[^\w\s\-]+", ""), r"(?U)(?=[_-])(?:[_-]+(?!\S)|(?<!\S)[_-]+)", "")
    kept = F.filter(split_words(F.lower(bare)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def ordered_distinct(values: Column) -> Column:
    """First occurrence of every value by its lower-cased form, order kept; nulls stay.

    Sorted by form and place, a first occurrence is one whose neighbour before has another form, so long lists take no comparison of all values with all.
    """
    keyed = F.sort_array(F.transform(values, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))

    def firsts(s: Column) -> Column:
        new = lambda x, at: (at == 0) | F.coalesce(x["k"] != F.get(s, at - 1)["k"], F.lit(True))
        return F.transform(F.sort_array(F.transform(F.filter(s, new), lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])

    return let(keyed, firsts)


def merge_queries(*groups: Column, clean=squash) -> Column:
    """Concatenate query lists, clean every entry, drop blanks and later repeats."""
    joined = F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups])
    return ordered_distinct(F.filter(F.transform(joined, lambda q: clean(blank(q))), lambda q: q != ""))


def join_words(words: Column) -> Column:
    """Space-join without a space before closing punctuation."""
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"(?U)\s+([,.!?;:…])", "$1"))


def clean_action_query(col: Column) -> Column:
    bare = F.regexp_replace(squash_edges(blank(col)), rf"{_starts('rdvbspm')}(?iU)\b({ACTION_BOILERPLATE})\b", " ")
    return F.substring(squash(bare), 1, 120)


def clean_beat_query(col: Column) -> Column:
    return F.substring(squash_edges(blank(col)), 1, 160)


def clean_overlay_query(col: Column) -> Column:
    # The first 100 characters hold at most 100 of the kept ones, so the search ends behind that many.
    head = F.regexp_extract(blank(col), r"^[^a-zA-Z0-9'\-]*+(?:[a-zA-Z0-9'\-][^a-zA-Z0-9'\-]*+){0,100}", 0)
    return F.substring(squash(F.regexp_replace(head, r"[^a-zA-Z0-9 '\-]+", " ")), 1, 100)


def clean_footage_subject(col: Column) -> Column:
    bare = squash_edges(F.regexp_replace(blank(col), rf"{_starts('pieha')}(?iU)\b({STILL_BOILERPLATE})\b", " "))
    return F.when(bare == "", "real human action").otherwise(bare)


def strip_constraints(col: Column) -> Column:
    return squash_edges(F.regexp_replace(col, rf"{_starts('1qthpi')}(?iU)\b(?:{PERIOD_PHRASES})\b", " "))


def judge_intent(description: Column, query: Column, caption: Column, locked: Column) -> Column:
    """Text shown to a judge: unlocked scenes lose the soft setting note."""
    value = first_filled(description, query, F.lit("documentary scene"))
    soft = F.regexp_replace(value, r"(?iU)(?:\.|\s)*Soft historical setting:\s*[^.]+\.?", "")
    bare = F.regexp_replace(F.regexp_replace(soft, r"(?U)\s+", " "), r"^[ .,\-]+|[ .,\-]+$", "")
    return F.when(locked, value).otherwise(first_filled(bare, caption, query, F.lit("documentary scene")))


def query_signature(col: Column) -> Column:
    found = F.regexp_extract_all(F.lower(blank(col)), F.lit("[a-zа-яё][a-zа-яё-]{2,}"), F.lit(0))
    return F.array_join(F.slice(F.filter(found, lambda t: ~t.isin(*SIGNATURE_STOP)), 1, 4), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens between two token sets; 0 when either is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)),
    ).otherwise(F.lit(0.0))


def title_similarity(title: Column, previous: Column) -> Column:
    """Highest token overlap between a title and a list of earlier titles."""
    return let(
        tokens(title),
        lambda cur: F.coalesce(F.array_max(F.transform(previous, lambda p: jaccard(cur, tokens(p)))), F.lit(0.0)),
    )


def explicit_quantity(col: Column, pattern: str = QUANTITY) -> Column:
    hit = F.regexp_extract(blank(col), "(?iU)" + pattern, 0)
    return F.when(hit != "", squash(hit))


def label_is_spoken(caption: Column, label: Column) -> Column:
    return let(
        fx_tokens(label),
        lambda lab: (F.size(lab) > 0) & (F.size(F.array_except(lab, fx_tokens(caption))) == 0),
    )


def anchor_start(words: Column, anchor: Column) -> Column:
    """Start of the first caption word where the anchor phrase is spoken; null if it is not.

    ``words`` is an array of structs with ``start_ms`` and ``text``.
    """

    def search(bundle: Column) -> Column:
        heads, wanted = bundle.heads, bundle.wanted
        exact = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(heads) - F.size(wanted) + 1, F.lit(1))),
            lambda i: F.slice(heads, i, F.size(wanted)) == wanted,
        )
        loose = F.filter(
            F.sequence(F.lit(1), F.size(heads)),
            lambda i: F.exists(
                wanted,
                lambda w: (F.length(w) > 3)
                & (F.contains(F.element_at(heads, i), w) | F.contains(w, F.element_at(heads, i))),
            ),
        )
        return F.when(
            (F.size(wanted) > 0) & (F.size(heads) > 0), F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(loose, F.lit(1)))
        )

    heads = F.transform(words, lambda w: F.coalesce(F.try_element_at(fx_tokens(w["text"]), F.lit(1)), F.lit("")))
    at = let(F.struct(heads.alias("heads"), fx_tokens(anchor).alias("wanted")), search)
    return F.try_element_at(F.transform(words, lambda w: w["start_ms"]), at)


def short_label(anchor: Column) -> Column:
    return let(
        split_words(blank(anchor)),
        lambda ws: F.when(
            F.size(ws).between(1, 3) & (F.length(F.array_join(ws, " ")) <= 22), F.upper(F.array_join(ws, " "))
        ).otherwise(""),
    )


def fallback_query(caption: Column, mode: Column) -> Column:
    """First four words of four or more characters plus a medium suffix."""
    bare = split_words(F.regexp_replace(blank(caption), r"(?U)[^\w\s-]+", ""))
    base = F.array_join(F.slice(F.filter(bare, lambda w: F.length(w) >= 4), 1, 4), " ")
    suffix = F.when(mode == "video", "real footage").otherwise("documentary image")
    return F.concat_ws(" ", F.when(base == "", "human reaction").otherwise(base), suffix)


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def clean_html(col: Column, full_entities: bool = False) -> Column:
    """Tags become spaces, entities are decoded, edges trimmed.

    The common entities are decoded inside the JVM. ``full_entities`` uses the
    complete table through one Arrow function instead.
    """
    bare = F.regexp_replace(blank(col), "<[^>]+>", " ")
    if full_entities:
        text = _unescape(bare)
    else:
        text = bare
        # The entities decoded natively; the ampersand comes last.
        for name, char in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
        ):
            text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
