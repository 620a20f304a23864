import pytest

from tamis.operators.decision import PATTERNS, POLICY
from tamis.sources.policies import policy_faults, policy_numbers, read_mapping

TEXT = """# a policy
weights_basis_points:
  screening_score: 4500
  countervailing_support: 4000
  release_support: 5000  # a note
thresholds_basis_points:
  clear_maximum: 2500
  escalate_minimum: 8500
  minimum_release_support_for_clear: 7000
  minimum_countervailing_for_escalate: 9000

controls:
  allow_auto_clear: true
  allow_escalation: true
pattern_rules:
""" + "".join(f"  {p}:\n    maximum_disposition: {v[4]}\n    score_adjustment_basis_points: {v[3]}\n" for p, v in PATTERNS.items())


def test_policy_file():
    policy = read_mapping(TEXT)
    assert policy_numbers(policy) == POLICY and policy_faults(policy, list(PATTERNS)) == []
    assert {k: v["score_adjustment_basis_points"] for k, v in policy["pattern_rules"].items()} == {k: v[3] for k, v in PATTERNS.items()}
    tenant = policy_numbers(policy, {"threshold_overrides_basis_points": {"clear_maximum": 1500}, "control_overrides": {"allow_escalation": False}})
    assert tenant == POLICY | {"clear_most": 1500, "escalation": 0}
    policy["thresholds_basis_points"]["clear_maximum"] = 9000
    assert policy_faults(policy, [*PATTERNS, "other"]) == ["clear_maximum isn't below escalate_minimum", "pattern other"]


@pytest.mark.parametrize(
    ("text", "why"),
    [("a: 1\na: 2", "line 2: a repeated key"), ("a:\n    b: 1", "line 2: a jump"), ("- a", "line 1: a list"), ("a: &x", "line 1: a list or an anchor"), ("a:\tb", "line 1: a tab"), ("word", "line 1: no key"), ("a: |", "multi-line")],
)
def test_strict_reading(text, why):
    with pytest.raises(ValueError, match=why):
        read_mapping(text)


def test_values():
    assert read_mapping('a: "x:#1"\nb:\n  c: -3\n  d: false\ne: v1.0') == {"a": "x:#1", "b": {"c": -3, "d": False}, "e": "v1.0"}
