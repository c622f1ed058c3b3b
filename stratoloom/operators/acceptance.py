"""Acceptance criteria as JSON trees over the summaries of two arms."""

from __future__ import annotations

from . import stats as S

KINDS = ("all", "any", "not", "significant", "equivalent", "effect_at_least", "relative_change", "threshold")


def evaluate(criterion: dict, arms: dict) -> dict:
    """``{"accepted", "detail"}`` of a criterion tree.

    ``arms`` has ``n_t, mean_t, var_t, median_t`` and the same for ``_c``.  Leaves: ``significant`` (alpha,
    direction greater or less), ``equivalent`` (margin, alpha), ``effect_at_least`` (d), ``relative_change``
    (of medians; least or most), ``threshold`` (of the treatment's mean or median; least or most).
    """
    kind = criterion.get("kind")
    if kind not in KINDS:
        raise ValueError(f"unknown criterion {kind!r}")
    if kind in ("all", "any"):
        parts = [evaluate(c, arms) for c in criterion["of"]]
        return {"accepted": (all if kind == "all" else any)(p["accepted"] for p in parts), "detail": parts}
    if kind == "not":
        part = evaluate(criterion["of"], arms)
        return {"accepted": not part["accepted"], "detail": [part]}
    six = [arms[k] for k in ("n_t", "mean_t", "var_t", "n_c", "mean_c", "var_c")]
    if kind == "significant":
        w = S.welch_test(*six)
        side = criterion.get("direction")
        right = side is None or (w["t"] > 0) == (side == "greater")
        return {"accepted": w["p"] <= criterion.get("alpha", 0.05) and right, "detail": w}
    if kind == "equivalent":
        w = S.equivalence_test(*six, criterion["margin"])
        return {"accepted": w["p"] <= criterion.get("alpha", 0.05), "detail": w}
    if kind == "effect_at_least":
        n, m = arms["n_t"], arms["n_c"]
        pooled = (((n - 1) * arms["var_t"] + (m - 1) * arms["var_c"]) / (n + m - 2)) ** 0.5
        d = (arms["mean_t"] - arms["mean_c"]) / pooled if pooled else 0.0
        return {"accepted": abs(d) >= criterion["d"], "detail": {"d": d}}
    if kind == "relative_change":
        value = (arms["median_t"] - arms["median_c"]) / abs(arms["median_c"]) if arms["median_c"] else None
    else:
        value = arms[f"{criterion.get('of', 'mean')}_t"]
    ok = value is not None and value >= criterion.get("least", float("-inf")) and value <= criterion.get("most", float("inf"))
    return {"accepted": ok, "detail": {"value": value}}
