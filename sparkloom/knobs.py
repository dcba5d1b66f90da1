"""Fixed values of the measures: the one place for thresholds, caps and weights."""

# Similarity of documents
SHINGLE_WORDS, MIN_WORDS, JACCARD, VERBATIM_WORDS, HOT_CAP = 5, 50, (80, 100), 50, 64
# Clone runs over token k-grams
KGRAM, WINDOW, RUN_TOKENS, NEAR_MISS, MIN_DISTINCT = 25, 26, 50, 25, 7
# Near-equal sizes and trees
SIZE_RATIO, TREE_RATIO, MIN_NODES = (85, 100), (85, 100), 24
# Co-change
COCHANGE_FLOOR, COMMIT_FILES = 2, 20
# Ratchet
TOLERANCE, TOLERANCE_ABS = (102, 100), 10
# Soft lines
SOFT, HARD, ZONE_MAX, SOFT_CLAMP = 300, 750, 10, (200, 500)
# Scores
SCALE, NEUTRAL_COST = 1000, 10
# Structure
DEPTH, FANOUT, BIG_DIR, MIX, MISPLACED = 8, 30, 8, 5, 3
# Splits: prices of a severed reference, a cut clone, a severed co-change and a new file, in thousandths
SPLIT_REF, SPLIT_CLONE, SPLIT_CHURN, SPLIT_FILE = 250, 500, 150, 500
# Trends
MIN_POINTS = 3
# Moves between two texts
MOVE_ANCHOR, MOVE_LINES, STACK_LINES, STACK_RATIO, BRIDGE = 19, 2, 20, 10, 7
# Grades: measure code, warn above, fail above (0: no hard line)
GRADES = ((0, 300, 750), (1, 50, 75), (2, 5, 0), (3, 15, 0), (4, 15, 0), (5, 4, 0), (6, 0, 0))


def checked(given: dict) -> dict:
    """Settings that a caller may override, with the defaults for the rest. Unknown names and ladders that do not ascend are refused."""
    defaults = {
        "min_words": MIN_WORDS, "hot_cap": HOT_CAP, "near_miss": NEAR_MISS, "run_tokens": RUN_TOKENS, "min_distinct": MIN_DISTINCT, "soft": SOFT, "hard": HARD,
        "zone_max": ZONE_MAX, "depth": DEPTH, "fanout": FANOUT, "min_points": MIN_POINTS, "bridge": BRIDGE,
    }
    unknown = sorted(given.keys() - defaults.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = defaults | given
    wrong = [k for k, v in out.items() if not isinstance(v, int) or isinstance(v, bool) or v < 1]
    if wrong:
        raise ValueError(f"not positive whole numbers: {', '.join(sorted(wrong))}")
    for low, high in (("soft", "hard"), ("near_miss", "run_tokens")):
        if out[low] >= out[high]:
            raise ValueError(f"{low} has to be less than {high}")
    return out
