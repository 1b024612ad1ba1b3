"""Role dimension, discovery-source bits and the predicates built on them."""

from pyspark.sql import Column, functions as F

from .. import fixed


def choose(key: Column, table: dict, default) -> Column:
    """A small literal lookup table as one CASE expression."""
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def role_weight(role: Column) -> Column:
    return choose(role, fixed.ROLE_WEIGHT, fixed.UNKNOWN_ROLE_WEIGHT)


def role_order(role: Column) -> Column:
    order = {r: i for i, r in enumerate(fixed.ROLE_DISPLAY_ORDER)}
    return choose(role, order, len(fixed.ROLE_DISPLAY_ORDER))


def role_label(role: Column) -> Column:
    return choose(role, fixed.ROLE_LABEL, role)


def is_weak(role: Column) -> Column:
    return role.isin(fixed.WEAK_ROLES)


def discovered_page_role(raw: Column) -> Column:
    """Role of a discovered page: council-like wording, else maintainer."""
    low = F.lower(F.coalesce(raw, F.lit("maintainer")))
    return F.when(low.contains("steer") | low.contains("council"), "steering_council") \
            .otherwise("maintainer")


# --- discovery sources as bits ---------------------------------------------
def source_bit(label: Column) -> Column:
    return choose(label, {s: F.lit(1 << i).cast("bigint") for i, s in enumerate(fixed.SOURCES)},
                  F.lit(0).cast("bigint"))


def bits(*labels: str) -> int:
    return sum(1 << fixed.SOURCES.index(s) for s in labels)


def has_any(mask: Column, labels) -> Column:
    return mask.bitwiseAND(F.lit(bits(*labels)).cast("bigint")) != 0


def source_labels(mask: Column) -> Column:
    """The sources of a mask, sorted by name."""
    return F.array_sort(F.array_compact(F.array(*[
        F.when(has_any(mask, [s]), F.lit(s)) for s in fixed.SOURCES])))


def is_genuine(mask: Column) -> Column:
    """Found through a live contribution, which a vendored copy cannot fake."""
    return has_any(mask, fixed.GENUINE_SOURCES)


def is_speculative(mask: Column) -> Column:
    """No person-side source at all: organisation membership or registry only."""
    others = [s for s in fixed.SOURCES if s not in fixed.SPECULATIVE_SOURCES]
    return (mask != 0) & ~has_any(mask, others)


def is_manual(mask: Column) -> Column:
    return has_any(mask, ["manual"])


# --- confidences -----------------------------------------------------------
def contributor_confidence(commits: Column, rank: Column, min_ranked: int = 10) -> Column:
    return (F.when(commits >= 100, F.lit(0.8))
             .when(commits >= 25, F.lit(0.6))
             .when((commits >= min_ranked) & (rank <= 10), F.lit(0.8)))


def path_confidence(commits: Column) -> Column:
    return (F.when(commits >= 50, F.lit(0.85))
             .when(commits >= 15, F.lit(0.7))
             .when(commits >= 5, F.lit(0.55)))


def release_confidence(mine: Column, total: Column) -> Column:
    share = mine.cast("double") / total.cast("double")
    raw = F.least(F.lit(0.9), F.lit(0.55) + F.lit(0.35) * share)
    return F.when(mine >= 2, F.round(raw, 2))


def is_bot(login: Column) -> Column:
    return F.coalesce(login.rlike(fixed.BOT_LOGIN), F.lit(False))


# --- project standing ------------------------------------------------------
def popularity(stars: Column, forks: Column, has_stars: Column) -> Column:
    return F.when(F.coalesce(has_stars, F.lit(True)), stars).otherwise(forks)


def is_maintained(pushed_at: Column, as_of: str) -> Column:
    """Pushed within 24 months of 30 days; an unknown date counts as maintained."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    age_days = F.floor((now - F.unix_timestamp(pushed_at)) / F.lit(86400))
    return F.coalesce(age_days <= 720, F.lit(True))


def fifth(min_stars: int, at_least: int) -> int:
    return max(at_least, min_stars // 5)


def is_widely_used(pop: Column, forks: Column, pushed_at: Column, as_of: str,
                   min_stars: int) -> Column:
    used = (forks >= 5) | (pop >= fifth(min_stars, 5))
    return used & is_maintained(pushed_at, as_of)


def is_notable_authored(role: Column, pop: Column, forks: Column) -> Column:
    return (role == "author") & ((pop >= 5) | (forks >= 3))


def is_high_signal(role: Column, confidence: Column, pop: Column, min_stars: int) -> Column:
    return (role.isin(fixed.HIGH_SIGNAL_ROLES) & (confidence >= 0.7)
            & (pop >= fifth(min_stars, 10)))
