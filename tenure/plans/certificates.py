"""Fits with their certificates: SQL states what must hold and counts the rows again."""

from __future__ import annotations

from tenure.constants import CLUSTER_FEATURES, SURVIVAL_FEATURES
from tenure.operators import btyd, certificates, cox, models, segment
from tenure.plans.analytics import rfm
from tenure.plans.base import query
from tenure.plans.modeling import conversion_rows, repeat_rows
from tenure.session import checkpointed


def _holds(names, column: str, flags: tuple[str, ...], count: str) -> str:
    values = ", ".join(f"({n!r})" if isinstance(n, str) else f"({n})" for n in names)
    return f"SELECT {column}, ({count}) AS customers, " + ", ".join(f"1 AS {f}" for f in flags) + f" FROM (VALUES {values}) v({column})"


@query("j02c_bgnbd_certificate", _holds(("r", "alpha", "a", "b"), "parameter", ("stationary", "largest"), "SELECT count(*) FROM rfm"))
def bgnbd_certificate(spark, sf):
    base = checkpointed(rfm(spark, sf))
    return certificates.bgnbd(base, btyd.fit_bgnbd(base, penalty=0.001), penalty=0.001)


@query("j12c_bgnbd_map_certificate", _holds(("r", "alpha", "a", "b"), "parameter", ("stationary", "largest"), "SELECT count(*) FROM rfm"))
def bgnbd_map_certificate(spark, sf):
    base = checkpointed(rfm(spark, sf))
    return certificates.bgnbd(base, btyd.fit_bgnbd(base, prior_sigma=10.0), prior_sigma=10.0)


@query("j06c_gamma_gamma_certificate", _holds(("p", "q", "v"), "parameter", ("stationary", "largest"),
                                              "SELECT count(*) FROM rfm WHERE frequency > 0 AND monetary_value > 0"))
def gamma_gamma_certificate(spark, sf):
    base = checkpointed(rfm(spark, sf))
    return certificates.gamma_gamma(base, btyd.fit_gamma_gamma(base, penalty=0.001), penalty=0.001)


@query("k12c_cox_certificate", _holds(SURVIVAL_FEATURES, "feature", ("score_zero",), "SELECT count(*) FROM surv_seg WHERE segment <> 'One-Timer'"))
def cox_certificate(spark, sf):
    rows = checkpointed(repeat_rows(spark, sf))
    return certificates.cox_score(rows, cox.fit_cox(rows, SURVIVAL_FEATURES, penalty=0.01), 0.01)


@query("i02c_pca_certificate", _holds((1, 2, 3), "component", ("eigenvector", "falling"), "SELECT count(*) FROM rfm WHERE frequency > 0"))
def pca_certificate(spark, sf):
    repeat = checkpointed(rfm(spark, sf).where("frequency > 0"))
    _, load, shares = segment.pca(repeat, CLUSTER_FEATURES)
    return certificates.components(repeat, CLUSTER_FEATURES, load, shares)


@query("i03c_kmeans_certificate", "SELECT 3 AS clusters, count(*) AS customers, 1 AS nearest FROM rfm WHERE frequency > 0")
def kmeans_certificate(spark, sf):
    found = checkpointed(segment.segment_repeat(rfm(spark, sf), CLUSTER_FEATURES).select("customer_id", "cluster", "pc1", "pc2", "pc3"))
    return certificates.clusters(found, ("pc1", "pc2", "pc3"))


@query("m02c_logistic_certificate")
def logistic_certificate(spark, sf):
    train, _, cols = conversion_rows(spark, sf)
    return certificates.logistic_score(train, cols, models.logistic(train, cols))
