"""Names and texts as columns: tokens, overlap, edit and affix similarity. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between a lower-case letter or digit and an upper-case one, between capitals and a word, and at separators.
BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-\s.]+"


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a camel, Pascal or snake name that have at least two characters."""
    return F.filter(F.transform(F.split(name, BOUNDARY), F.lower), lambda t: F.length(t) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 where there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, blind to case; two empty names are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longer)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share from the left."""
    shorter = F.least(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
    same = F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(shorter == 0, 0).otherwise(F.size(same))


def affix_similarity(a: Column, b: Column) -> Column:
    """Common prefix plus non-overlapping common suffix over the longer length, blind to case."""
    a, b = F.lower(a), F.lower(b)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    head = common_prefix(a, b)
    tail = F.least(common_prefix(F.reverse(a), F.reverse(b)), shorter - head)
    return F.when(longer == 0, 1.0).otherwise((head + tail) / longer)


def token_similarity(a: Column, b: Column) -> Column:
    """Mean over the left tokens of the best match: equal 1, contained by length ratio, else prefix of three or more."""

    def best(t: Column) -> Column:
        def one(u: Column) -> Column:
            longer, shorter = F.greatest(F.length(t), F.length(u)), F.least(F.length(t), F.length(u))
            prefix = common_prefix(t, u)
            contained = F.contains(t, u) | F.contains(u, t)
            return F.when(t == u, 1.0).when(contained, shorter / longer).when(prefix >= 3, prefix / longer).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(b, one)), F.lit(0.0))

    total = F.aggregate(F.transform(a, best), F.lit(0.0), lambda x, y: x + y)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(total / F.size(a))


def capital_tokens(name: Column) -> Column:
    """Lower-case parts of a name that begin at its capitals, of letters and digits only."""
    parts = F.split(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""), r"(?<=.)(?=\p{Lu})")
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) > 0)


def spelling_score(a: Column, b: Column) -> Column:
    """Edit similarity of two lower-case strings; 0.8 if one contains the other, 0.7 + 0.02 a character from a common prefix of four."""
    edit = edit_similarity(a, b)
    edit = F.when(F.contains(a, b) | F.contains(b, a), F.greatest(edit, F.lit(0.8))).otherwise(edit)
    prefixed = (F.length(a) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
    return F.when(prefixed, F.greatest(edit, 0.7 + common_prefix(a, b) * 0.02)).otherwise(edit)


def token_score(a: Column, b: Column) -> Column:
    """Left tokens that contain a right one or lie in one, over the larger count."""
    met = F.filter(a, lambda s: F.exists(b, lambda t: F.contains(t, s) | F.contains(s, t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(met) / F.greatest(F.size(a), F.size(b)))


def type_bonus(a: Column, b: Column) -> Column:
    """0.15 for equal type names, 0.05 where one contains the other."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, 0.15).when(F.contains(a, b) | F.contains(b, a), 0.05).otherwise(0.0)


def content_hash(x: Column) -> Column:
    """Upper-case SHA-256; a null is hashed as empty."""
    return F.upper(F.sha2(F.coalesce(x, F.lit("")).cast("binary"), 256))


def joined_hash(*parts: Column) -> Column:
    """Hash of strings joined by NUL, so that their borders count."""
    return content_hash(F.concat_ws("\x00", *(F.coalesce(p, F.lit("")) for p in parts)))
