"""Asked names with edits anywhere, the first character too, against all names."""

import random

from ledgerlens.operators import orgs


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_names_with_a_damaged_first_letter(spark):
    rng = random.Random(3)
    ministries = ["Ministry of Finance", "Ministry of the Interior", "Department of Health and", "Bureau of Roads", "Office of the Prime Minister's"]
    facts = [(str(k), name, f"{k}{j}", f"Agency for things of {k}{j}", 10 * k + j) for k, name in enumerate(ministries) for j in range(2)]
    names = orgs.organisations(spark.createDataFrame(facts, "min_code string, min_name string, agc_code string, agc_name string, row_no int"))
    asked = {"inistry of Finance", "Xinistry of Finance", "XMinistry of Finance", "XYinistry of Finance", "YXBureau of Roads", "ureau of Roads", "Xureau of Roads", "partment of Health and", "Department of Health annd", "nowhere"}
    for name in ministries:  # 1 or 2 edits at any place
        for n in (1, 2, 2, 3):
            x = list(name)
            for _ in range(n):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice(([], ["q"], [x[at], "q"]))
            asked.add("".join(x).strip())
    asked = {a for a in asked if "  " not in a}
    found = orgs.resolve(spark.createDataFrame([(a, "Agency for things of 01") for a in asked], "ministry string, agency string"), names)
    got = {r["ministry"]: "ministry_unmapped" not in r["flags"] and r["ministry_code"] for r in found.collect()}
    # An agency's exact spelling gives an unknown ministry the agency's own: only then is the code that of ministry 0.
    want = {}
    for a in asked:
        score, code = max((1 - _edits(a, m) / max(len(a), len(m)), str(k)) for k, m in enumerate(ministries))
        want[a] = code if score >= orgs.MIN_SIMILARITY else "0"
    assert got == want
    methods = {r["ministry"]: (r["method"], r["agency_code"]) for r in found.collect()}
    assert methods["Xinistry of Finance"] == ("fuzzy", "01") and methods["ureau of Roads"] == ("fuzzy", "31")
