"""Dempster-Shafer masses of one review and the label they imply."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Degree up to which an endpoint's mass is discounted, and the
# share of a product's mass that is trusted at all.
FULL_TRUST_USER_DEGREE = 5
FULL_TRUST_PRODUCT_DEGREE = 30
PRODUCT_TRUST = 0.7

#: Masses are taken in whole steps of 10**-6 before they are rounded any further, so that
#: the last bits of a float, which depend on the order of a sum, do not decide a half.
STEP_DIGITS = 6


def fuse(
    u_deg: Column, p_deg: Column, fraud: Column, honest: Column, bad: Column, good: Column, score: Column
) -> dict[str, Column]:
    """The masses fake, genuine and uncertainty from both endpoints' beliefs.

    Null when an input is null or when the two sources contradict each other
    completely (conflict of 1 or more).
    """
    user_trust = F.least(u_deg / F.lit(float(FULL_TRUST_USER_DEGREE)), F.lit(1.0))
    product_trust = F.lit(PRODUCT_TRUST) * F.least(p_deg / F.lit(float(FULL_TRUST_PRODUCT_DEGREE)), F.lit(1.0))

    f1, g1 = fraud * user_trust, honest * user_trust
    u1 = (fraud + honest) * (1.0 - user_trust)

    f2 = F.when(score > 0, bad).when(score <= 0, good) * product_trust
    g2 = F.when(score > 0, good).when(score <= 0, bad) * product_trust
    # What the fixed discount removes is exactly 1 - PRODUCT_TRUST; what the
    # degree discount removes depends on the beliefs' own sum.
    u2 = F.lit(1.0 - PRODUCT_TRUST) + (bad + good) * (F.lit(PRODUCT_TRUST) - product_trust)

    agreement = F.nullif(F.greatest(1.0 - (f1 * g2 + g1 * f2), F.lit(0.0)), F.lit(0.0))
    return {
        "fake": (f1 * f2 + f1 * u2 + u1 * f2) / agreement,
        "genuine": (g1 * g2 + g1 * u2 + u1 * g2) / agreement,
        "uncertainty": (u1 * u2) / agreement,
    }


def in_units(mass: Column, digits: int = 2) -> Column:
    """The mass in whole units of 10**-digits, a half going up; exact up to ``STEP_DIGITS`` digits."""
    if not 0 <= digits <= STEP_DIGITS:
        raise ValueError(f"digits must be 0 to {STEP_DIGITS}, not {digits}")
    steps = F.round(mass * F.lit(float(10**STEP_DIGITS))).cast("bigint")
    unit = 10 ** (STEP_DIGITS - digits)
    return steps if unit == 1 else F.floor((steps + unit // 2) / unit).cast("bigint")


def as_map(fake: Column, genuine: Column, uncertainty: Column) -> Column:
    """map<string,double> of the three masses, null where there are none."""
    return F.when(
        fake.isNotNull(),
        F.create_map(F.lit("fake"), fake, F.lit("genuine"), genuine, F.lit("uncertainty"), uncertainty),
    )


def decide(fake: Column, genuine: Column, uncertainty: Column) -> Column:
    """'uncertain', 'fake' or 'genuine'; a fake/genuine tie is genuine, no masses no label.

    Sums are compared, so the masses should be whole units (:func:`in_units`).
    """
    return (
        F.when(uncertainty > fake + genuine, "uncertain")
        .when(fake > genuine, "fake")
        .when(fake <= genuine, "genuine")
    )
