"""Policy files: mappings by indentation with plain values, read strictly on the driver."""

from __future__ import annotations

import json
import re


def scalar(value: str):
    value = value.split(" #", 1)[0].strip()
    if not value or value[0] in "|>!":
        raise ValueError("empty, multi-line or tagged value")
    if value[0] == '"':
        return json.loads(value)
    if value in ("true", "false"):
        return value == "true"
    return int(value) if re.fullmatch(r"-?\d+", value) else value


def read_mapping(content: str) -> dict:
    """Nested mappings in steps of two spaces.  Lists, anchors, tabs, repeated keys and jumps are errors that name the line."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-2, root)]
    for number, raw in enumerate(content.splitlines(), 1):
        line, said = raw.rstrip(), raw.strip()
        if not said or said.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip(" "))
        key, colon, rest = said.partition(":")
        key = key.strip()
        while len(open_) > 1 and depth <= open_[-1][0]:
            open_.pop()
        above, here = open_[-1]
        wrong = (
            "a tab" if "\t" in line
            else "a list or an anchor" if said[0] == "-" or "&" in said or "*" in said
            else "no key" if not colon or not key or set(key) & set("{}[]")
            else "a jump of indentation" if depth != above + 2
            else "a repeated key" if key in here
            else ""
        )
        if wrong:
            raise ValueError(f"line {number}: {wrong}")
        if rest.strip():
            here[key] = scalar(rest.strip())
        else:
            here[key] = {}
            open_.append((depth, here[key]))
    return root


def policy_faults(policy: dict, patterns: list[str]) -> list[str]:
    """What is wrong with a policy: weights or thresholds out of range or order, patterns missing, dispositions unknown."""
    out = []
    weights, bounds = policy.get("weights_basis_points", {}), policy.get("thresholds_basis_points", {})
    out += [f"weight {k}" for k, v in weights.items() if not isinstance(v, int) or not 0 <= v <= 10000]
    out += [f"threshold {k}" for k, v in bounds.items() if not isinstance(v, int) or not 0 <= v <= 10000]
    if not out and bounds.get("clear_maximum", 0) >= bounds.get("escalate_minimum", 10000):
        out.append("clear_maximum isn't below escalate_minimum")
    rules = policy.get("pattern_rules", {})
    out += [f"pattern {p}" for p in patterns if p not in rules]
    out += [f"disposition of {k}" for k, v in rules.items() if v.get("maximum_disposition") not in ("clear", "investigate", "escalate")]
    return out


def policy_numbers(policy: dict, overlay: dict | None = None) -> dict[str, int]:
    """The numbers that `tamis.operators.decision` takes, a tenant's overlay over the policy's own."""
    overlay = overlay or {}
    weights = policy["weights_basis_points"] | overlay.get("weight_overrides_basis_points", {})
    bounds = policy["thresholds_basis_points"] | overlay.get("threshold_overrides_basis_points", {})
    controls = policy["controls"] | overlay.get("control_overrides", {})
    return {
        "screening": weights["screening_score"], "countervailing": weights["countervailing_support"], "release": weights["release_support"],
        "clear_most": bounds["clear_maximum"], "escalate_least": bounds["escalate_minimum"], "release_least": bounds["minimum_release_support_for_clear"],
        "countervailing_least": bounds["minimum_countervailing_for_escalate"], "auto_clear": int(controls["allow_auto_clear"]), "escalation": int(controls["allow_escalation"]),
    }
