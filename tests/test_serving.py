"""The fitted lead model, and published tables that are kept up and looked up."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from leadflow.operators import joins
from leadflow.operators.logistic import fit_logistic
from leadflow.operators.scoring import logistic_score
from leadflow.plans import jobs
from leadflow.sinks.keyed import KeyedTable

# Lead model


def drawn(n, seed, weights, intercept):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        x = [draw.gauss(5, 2), draw.expovariate(0.02)]
        z = intercept + sum(w * v for w, v in zip(weights, x))
        out.append((*x, draw.random() < 1 / (1 + math.exp(-z))))
    return out


def test_fit_is_the_maximum(rows):
    values = drawn(800, 1, [0.7, -0.02], -2.0)
    df = rows(values, "a double, b double, y boolean")
    fit = fit_logistic(df, ["a", "b"], "y")
    x = np.array([[1.0, a, b] for a, b, _ in values])
    y = np.array([float(v) for *_, v in values])
    beta = np.array([fit.intercept, fit.weights["a"], fit.weights["b"]])
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (y - p)).max() < 1e-5  # no direction is left to climb
    assert math.isclose(fit.log_likelihood, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), rel_tol=1e-9)
    errors = np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)))
    assert np.allclose([fit.errors[k] for k in ("", "a", "b")], errors, rtol=1e-6) and fit.rows == 800
    assert abs(fit.weights["a"] - 0.7) < 4 * fit.errors["a"]
    scored = df.select(logistic_score(fit.weights, fit.intercept).alias("s")).collect()
    assert np.allclose([r.s for r in scored], p, atol=1e-6)


def test_rows_without_values_take_no_part(rows):
    values = drawn(200, 2, [0.5, 0.0], -2.0)
    odd = [(None, 1.0, True), (1.0, float("nan"), True), (float("inf"), 1.0, False), (1.0, 1.0, None)]
    df = rows(values + odd, "a double, b double, y boolean")
    fit, plain = (fit_logistic(d, ["a", "b"], "y") for d in (df, rows(values, "a double, b double, y boolean")))
    assert fit.rows == 200 and math.isclose(fit.weights["a"], plain.weights["a"], rel_tol=1e-9)


@pytest.mark.parametrize("values, message", [
    ([(1.0, 1.0, True), (2.0, 5.0, True)], "both values"), ([], "both values"),
    ([(float(i), 0.5 * (i % 3), i >= 10) for i in range(20)], "separate|no weights"),
    ([(float(i % 7), 2.0 * (i % 7), i % 2 == 0) for i in range(60)], "depend"),
])
def test_what_has_no_fit_ends_the_job(rows, values, message):
    with pytest.raises(ValueError, match=message):
        fit_logistic(rows(values, "a double, b double, y boolean"), ["a", "b"], "y")


# Site visitors, kept up


VISITS = (
    "site_id bigint, visitor_id bigint, last_visit_date timestamp_ntz, visit_count bigint, ipaddress string, "
    "browser_agent string, created_at timestamp_ntz"
)
SITES, USERS = "id bigint, user_id bigint", "id bigint, tree_user_id bigint"
CODES = "user_id bigint, third_party_tracking_company string, tracking_code string"


def visit(site, visitor):
    return site, visitor, dt.datetime(2020, 1, 1), 1, "ip", "agent", None


def test_refresh_equals_a_full_build(spark, rows, folder):
    draw = random.Random(3)
    sites = [(i, i % 4) for i in range(8)]
    users, codes = [(0, 9), (1, 9), (2, 8)], [(0, "ga", "c0")]
    visits = [visit(draw.randrange(6), v) for v in range(20)]
    frames = lambda: (rows(sites, SITES), rows(visits, VISITS), rows(users, USERS), rows(codes, CODES))
    content = lambda df: sorted(map(str, df.select(*joins.SITE_COLUMNS, *joins.VISIT_COLUMNS).collect()))
    table = KeyedTable(spark, f"{folder}/t", joins.site_visitors(*frames()).schema, ["site_id"], share=100.0)
    jobs.publish_site_visitors(table, *frames())
    assert content(table.read()) == content(joins.site_visitors(*frames()))

    def refresh(new, changed, label):
        visits.extend(new)
        at = frames()
        return jobs.refresh_site_visitors(
            table, *at, rows(new, VISITS), rows([(i,) for i in changed], "site_id bigint"), label
        )

    # visits of known sites, of one without any until now, and of none that there is
    assert refresh([visit(0, 100), visit(6, 101), visit(99, 102)], [], "1").rows == 2
    assert content(table.read()) == content(joins.site_visitors(*frames()))
    # a site gets another user, one loses its user, one is new, a user gets a code
    sites[0], sites[1] = (0, 2), (1, 3)
    sites.append((8, 0))
    codes.append((2, "ga", "c2"))
    of_user_2 = [i for i, u in sites if u == 2]
    refresh([visit(0, 103), visit(8, 104)], [0, 1, 8, *of_user_2], "2")
    assert content(table.read()) == content(joins.site_visitors(*frames()))
    assert refresh([], [], "2").state == "skipped"
    table.compact()
    assert content(table.read()) == content(joins.site_visitors(*frames()))
    refresh([], [], "3")
    assert content(table.read()) == content(joins.site_visitors(*frames()))
