"""A published sample of 50 traces in one area, where its two files are at hand: TRACE_SAMPLE names the traces' GeoJSON file and
AREA_SAMPLE that of the area."""

import os

import pytest

from riftspark.plans.network import Network
from riftspark.sources import vector

TRACES, AREA = os.environ.get("TRACE_SAMPLE"), os.environ.get("AREA_SAMPLE")
#: Expected values, rounded to two places (fixed values).
COUNTS = {"X": 8, "Y": 25, "I": 59, "E": 16, "C-C": 33, "C-I": 33, "I-I": 10, "C-E": 8, "I-E": 6, "E-E": 1, "Number of Branches (Real)": 91, "Number of Traces (Real)": 50}
VALUES = {
    "Area": 534.68, "Areal Frequency B20": 0.16, "Areal Frequency P20": 0.08, "Branch Max Length": 4.11, "Branch Mean Length": 0.76, "Branch Min Length": 0.02, "Connection Frequency": 0.06, "Connections per Branch": 1.29,
    "Connections per Trace": 1.57, "Dimensionless Intensity B22": 0.09, "Dimensionless Intensity P22": 0.15, "Fracture Intensity P21": 0.12, "Number of Branches": 83.0, "Number of Traces": 42.0, "Trace Max Length": 5.7,
    "Trace Mean Length": 1.26, "Trace Min Length": 0.06,
}
FITS = {
    "trace": {
        "exponential_d": 0.16, "exponential_lambda": 0.85, "exponential_loglikelihood": -41.93, "lognormal_d": 0.12, "lognormal_loglikelihood": -39.55, "lognormal_mu": -1.35, "lognormal_sigma": 1.42,
        "lognormal_vs_exponential_r": 1.18, "lognormal_vs_exponential_p": 0.24, "d": 0.1, "alpha": 2.07, "xmin": 0.48, "exponent": -1.07, "sigma": 0.18, "power_law_vs_exponential_r": 0.44, "power_law_vs_exponential_p": 0.66,
        "power_law_vs_lognormal_r": -1.01, "power_law_vs_lognormal_p": 0.31, "power_law_vs_truncated_power_law_r": -1.35, "power_law_vs_truncated_power_law_p": 0.07, "truncated_power_law_d": 0.12,
        "truncated_power_law_alpha": 1.39, "truncated_power_law_exponent": -0.39, "truncated_power_law_lambda": 0.24, "truncated_power_law_loglikelihood": -38.95, "share": 0.28,
    },
    "branch": {
        "exponential_d": 0.12, "exponential_lambda": 1.28, "exponential_loglikelihood": -30.02, "lognormal_d": 0.07, "lognormal_loglikelihood": -29.08, "lognormal_mu": -0.98, "lognormal_sigma": 1.05,
        "lognormal_vs_exponential_r": 0.71, "lognormal_vs_exponential_p": 0.48, "d": 0.11, "alpha": 2.39, "xmin": 0.53, "exponent": -1.39, "sigma": 0.22, "power_law_vs_exponential_r": -0.14, "power_law_vs_exponential_p": 0.89,
        "power_law_vs_lognormal_r": -1.07, "power_law_vs_lognormal_p": 0.28, "power_law_vs_truncated_power_law_r": -1.35, "power_law_vs_truncated_power_law_p": 0.07, "truncated_power_law_d": 0.07,
        "truncated_power_law_alpha": 1.34, "truncated_power_law_exponent": -0.34, "truncated_power_law_lambda": 0.52, "truncated_power_law_loglikelihood": -28.71, "share": 0.56,
    },
}


@pytest.mark.skipif(not (TRACES and AREA), reason="TRACE_SAMPLE and AREA_SAMPLE aren't set")
def test_sample_network(spark):
    traces = vector.read_traces(spark, TRACES, "n").where("pts is not null").drop("parts")
    net = Network(traces, vector.read_areas(spark, AREA, "n"), snap=0.001)
    found = net.parameters().first().asDict() | net.node_counts().first().asDict() | net.branch_counts().first().asDict()
    assert {k: found[k] for k in COUNTS} == COUNTS
    near = lambda got, want: {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) > 0.0051}
    assert near(found, VALUES) == {}
    for branches, name in ((False, "trace"), (True, "branch")):
        assert near(net.fit_description(branches).first().asDict(), FITS[name]) == {}
