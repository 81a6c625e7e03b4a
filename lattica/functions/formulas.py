"""Degree formulas, as SQL over a vertex degree ``d`` or the end degrees ``du`` and ``dv`` of an edge that isn't a loop.

name: (what to sum, which rows count). Names that denote the same quantity share a row through ALIASES.
"""

from __future__ import annotations

ANY = "true"
ENDS = "du > 0 and dv > 0"

EDGE_SUMS: dict[str, tuple[str, str]] = {
    "degree_sum_index": ("sqrt(du + dv)", ANY),
    "augmented_zagreb_index": ("power(du * dv / (du + dv - 2), 3)", "du + dv > 2"),
    "atom_bond_sum_connectivity": ("sqrt((du + dv - 2) / (du + dv))", "du + dv > 2"),
    "geometric_arithmetic_index": ("2 * sqrt(du * dv) / (du + dv)", ENDS),
    "symmetric_degree_ratio": ("du / dv + dv / du", ENDS),
    "minmax_degree_ratio": ("least(du, dv) / greatest(du, dv)", ENDS),
    "degree_harmonic_mean_index": ("2 * du * dv / (du + dv)", ENDS),
    "degree_diff_connectivity": ("1 / sqrt(abs(du - dv) + 1)", ANY),
    "arithmetic_geometric_index": ("(du + dv) / (2 * sqrt(du * dv))", ENDS),
    "platt_index": ("du + dv - 2", ANY),
    "bertz_complexity_index": ("(du + dv - 2) * (du + dv - 3) / 2", "du + dv >= 4"),
    "edge_degree_geometric_sum": ("sqrt(du * dv)", ENDS),
    "edge_inverse_degree_sum": ("1 / (du + dv)", ENDS),
    "edge_degree_diff_ratio": ("abs(du - dv) / (du + dv)", ENDS),
    "edge_degree_sorensen": ("2 * least(du, dv) / (du + dv)", ENDS),
    "edge_degree_product_ratio": ("du * dv / ((du + dv) * (du + dv))", ENDS),
    "edge_degree_min_sum": ("least(du, dv)", ANY),
    "edge_degree_max_sum": ("greatest(du, dv)", ANY),
    "edge_degree_log_product": ("ln(du * dv)", ENDS),
    "edge_degree_mean_sum": ("(du + dv) / 2", ANY),
    "ird_index": ("abs(du * du - dv * dv)", ANY),
    "irb_index": ("power(sqrt(du) - sqrt(dv), 2)", ANY),
    "irga_index": ("ln((du + dv) / (2 * sqrt(du * dv)))", ENDS),
    "first_ev_degree_zagreb": ("power(du + dv - 2, 2)", ANY),
    "irl_irregularity": ("abs(ln(du) - ln(dv))", ENDS),
    "forgotten_index": ("du * du + dv * dv", ANY),
    "reduced_second_zagreb": ("(du - 1) * (dv - 1)", ANY),
    "reciprocal_randic_index": ("sqrt(du * dv)", ANY),
    "first_gourava_index": ("du + dv + du * dv", ANY),
    "second_gourava_index": ("(du + dv) * du * dv", ANY),
    "first_hyper_gourava_index": ("power(du + dv + du * dv, 2)", ANY),
    "first_hyper_zagreb": ("power(du + dv, 2)", ANY),
    "second_hyper_zagreb": ("power(du * dv, 2)", ANY),
    "first_redefined_zagreb": ("(du + dv) / (du * dv)", ENDS),
    "albertson_index": ("abs(du - dv)", ANY),
    "sigma_index": ("power(du - dv, 2)", ANY),
    "nirmala_index": ("sqrt(du + dv)", ANY),
    "first_inverse_nirmala": ("1 / sqrt(du + dv)", ENDS),
    "randic_index": ("1 / sqrt(du * dv)", ENDS),
    "reduced_reciprocal_randic": ("1 / sqrt((du - 1) * (dv - 1))", "du > 1 and dv > 1"),
    "reduced_sum_connectivity": ("1 / sqrt(du + dv - 2)", "du + dv > 2"),
    "first_reformulated_zagreb": ("power(du + dv - 2, 2)", ANY),
    "third_zagreb_index": ("abs(du - dv)", ANY),
    "sombor_index": ("sqrt(du * du + dv * dv)", ANY),
    "reduced_sombor_index": ("sqrt(power(du - 1, 2) + power(dv - 1, 2))", ANY),
    "elliptic_sombor_index": ("(du + dv) * sqrt(du * du + dv * dv)", ANY),
    "modified_sombor_index": ("1 / sqrt(du * du + dv * dv)", ENDS),
    "inverse_sum_indeg_index": ("du * dv / (du + dv)", ENDS),
    "symmetric_division_deg_index": ("(du * du + dv * dv) / (du * dv)", ENDS),
    "abc_index": ("sqrt((du + dv - 2) / (du * dv))", ENDS),
    "harmonic_graph_index": ("2 / (du + dv)", ENDS),
    "exponential_augmented_zagreb": ("exp(du * dv / (du + dv - 2))", "du + dv > 2"),
    "exponential_randic": ("exp(1 / sqrt(du * dv))", ENDS),
    "exponential_abc": ("exp(sqrt((du + dv - 2) / (du * dv)))", "du > 0 and dv > 0 and du + dv > 2"),
    "exponential_ga": ("exp(2 * sqrt(du * dv) / (du + dv))", ENDS),
    "exponential_sum_connectivity": ("exp(1 / sqrt(du + dv))", ENDS),
}

VERTEX_SUMS: dict[str, tuple[str, str]] = {
    "first_zagreb_index": ("d * d", ANY),
    "modified_first_zagreb": ("1 / (d * d)", "d > 0"),
    "inverse_degree_index": ("1 / d", "d > 0"),
    "reduced_first_zagreb": ("power(d - 1, 2)", "d > 0"),
    "reduced_forgotten_index": ("power(d - 1, 3)", "d > 0"),
    "gordon_scantlebury_index": ("d * (d - 1) / 2", ANY),
    "exponential_first_zagreb": ("exp(d * d)", ANY),
    "exponential_forgotten": ("exp(d * d * d)", ANY),
    "exponential_inverse_degree": ("exp(1 / d)", "d > 0"),
}

#: Products over edges or vertices, as exp(sum(ln)); rows with a factor that isn't positive are left out.
EDGE_PRODUCTS: dict[str, tuple[str, str]] = {
    "multiplicative_sum_connectivity": ("1 / sqrt(du + dv)", ENDS),
    "multiplicative_randic": ("1 / sqrt(du * dv)", ENDS),
    "multiplicative_abc": ("sqrt((du + dv - 2) / (du * dv))", "du > 0 and dv > 0 and du + dv > 2"),
    "multiplicative_ga": ("2 * sqrt(du * dv) / (du + dv)", ENDS),
    "second_multiplicative_zagreb": ("du * dv", ENDS),
}
VERTEX_PRODUCTS: dict[str, tuple[str, str]] = {
    "narumi_katayama_index": ("d", "d > 0"),
    "first_multiplicative_zagreb": ("d * d", "d > 0"),
}

#: Entropies of a share p of each edge in the sum of a weight.
EDGE_ENTROPIES: dict[str, tuple[str, str]] = {
    "first_zagreb_entropy": ("du + dv", ANY),
    "second_zagreb_entropy": ("du * dv", ENDS),
    "randic_entropy": ("1 / sqrt(du * dv)", ENDS),
    "abc_entropy": ("sqrt((du + dv - 2) / (du * dv))", "du > 0 and dv > 0 and du + dv > 2"),
}

#: With a parameter a.
EDGE_POWERS: dict[str, tuple[str, str]] = {
    "general_randic_index": ("power(du * dv, {a})", ENDS),
    "general_sum_connectivity_index": ("power(du + dv, {a})", ENDS),
    "variable_first_zagreb": ("power(du, {a}) + power(dv, {a})", ENDS),
    "ira_index": ("abs(power(du, {a}) - power(dv, {a}))", ENDS),
}
VERTEX_POWERS: dict[str, tuple[str, str]] = {
    "general_zeroth_order_randic": ("power(d, {a})", "d > 0"),
    "variable_sum_exdeg": ("d * power({a}, d)", ANY),
    "inverse_degree_power": ("1 / power(d, {a})", "d > 0"),
}

#: Sums over unordered pairs of distinct vertices that aren't adjacent: all pairs less edges.
COINDICES: dict[str, str] = {
    "sigma_coindex": "power(du - dv, 2)",
    "albertson_coindex": "abs(du - dv)",
    "forgotten_coindex": "du * du + dv * dv",
    "first_hyper_zagreb_coindex": "power(du + dv, 2)",
    "second_hyper_zagreb_coindex": "power(du * dv, 2)",
    "sombor_coindex": "sqrt(du * du + dv * dv)",
    "first_zagreb_coindex": "du + dv",
    "second_zagreb_coindex": "du * dv",
    "total_irregularity": "abs(du - dv)",
}

ALIASES: dict[str, str] = {
    "edge_degree_harmonic_sum": "degree_harmonic_mean_index",
    "edge_degree_ratio_sum": "minmax_degree_ratio",
    "second_inverse_nirmala": "randic_index",
    "irlu_irregularity": "irl_irregularity",
    "sum_connectivity_index": "first_inverse_nirmala",
    "bell_index": "degree_variance",
    "leaf_ratio": "degree_leaf_ratio",
    "degree_hierarchy": "degree_gini",
}
