"""Fixed values of the presets. One place; everything else is derived from here."""

from __future__ import annotations

# Attribute ids in source order; ids no model reports; further ids that the
# preset model never reports; ids critical for degradation.
ATTRIBUTE_IDS = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 170, 171, 172, 173, 174, 177, 180, 181, 182, 183, 184, 187, 188, 189,
    190, 191, 192, 193, 194, 195, 196, 197, 198, 199, 200, 204, 205, 206, 207, 211, 233, 240, 241, 242, 244, 245, 175, 232,
)
NEVER_REPORTED_IDS = (2, 3, 4, 6, 7, 8, 10, 11, 13, 189, 191, 193, 200, 204, 205, 207, 240)
MODEL_UNAVAILABLE_IDS = (175, 177, 181, 182, 190, 192, 232, 233, 241, 242, 244, 245)
CRITICAL_IDS = (5, 171, 172, 183, 184, 187, 197, 198, 199)

#: Rolling windows in days; each has a current window and the adjacent one before it.
WINDOW_DAYS = (7, 14, 30)
HORIZON_DAYS = 30
#: An alert is a hit from MIN_LEAD to HORIZON_DAYS days ahead of the failure.
MIN_LEAD = 7
EPISODE_DAYS = 30
#: Donors a peer group needs before its mode may impute.
MIN_DONORS = 20


def without(ids, *removed) -> tuple:
    """Ids in order, less those in any of the removed lists."""
    gone = {i for r in removed for i in r}
    return tuple(i for i in ids if i not in gone)


RETAINED_IDS = without(ATTRIBUTE_IDS, NEVER_REPORTED_IDS)
MODEL_IDS = tuple(sorted(without(RETAINED_IDS, MODEL_UNAVAILABLE_IDS)))


def context_days(windows=WINDOW_DAYS, horizon: int = HORIZON_DAYS) -> tuple[int, int]:
    """How far a filter on output dates is widened before and after, so that the edges come out right."""
    return 2 * max(windows) - 1, horizon
