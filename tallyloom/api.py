"""All cohort operators under the names their users know."""

from __future__ import annotations

from tallyloom.functions import not_in
from tallyloom.names import (
    add_delimiters,
    catalog_name,
    db_schema,
    has_internal_delimiters,
    is_delimited,
    remove_delimiters,
)
from tallyloom.names import inform as run_time_inform_user
from tallyloom.names import warn_if_undelimited as warn_if_missing_delimiters
from tallyloom.operators.checks import (
    assert_all_unique,
    assert_join_covered,
    assert_num_distinct,
    assert_size,
    assert_size_comparison,
    assert_size_missing,
    check_all_unique,
    check_join_covered,
    check_no_date_overlap,
    check_num_distinct,
    check_size,
    check_size_comparison,
    check_size_missing,
    num_missing_entries,
    num_row,
    num_unique_entries,
)
from tallyloom.operators.checks import compare as evaluation_comparison
from tallyloom.operators.confidential import (
    apply_graduated_random_rounding,
    apply_random_rounding,
    apply_small_count_suppression,
    confidentialise_results,
)
from tallyloom.operators.confidential import round_values as randomly_round_vector
from tallyloom.operators.disclosure import (
    check_absence_of_zero_counts,
    check_confidentialised_results,
    check_graduated_rounding_df,
    check_random_rounding,
    check_rounding_to_base_df,
    check_small_count_suppression,
    expand_to_include_zero_counts,
)
from tallyloom.operators.disclosure import check_rounding_to_base as check_rounding_to_base_array
from tallyloom.operators.profile import explore_report
from tallyloom.operators.profile import limited_rows as filter_to_limited_number_of_rows
from tallyloom.operators.reshape import bind_rows, collapse_indicator_columns, pivot_table, union_all
from tallyloom.operators.summarise import (
    cross_product_column_names,
    has_long_thin_format,
    summarise_and_label,
    summarise_and_label_over_lists,
)
from tallyloom.plans.assemble import assemble as dataset_assembly_tool
from tallyloom.plans.assemble import long_thin as assemble_output_table
from tallyloom.plans.assemble import rectangular as prepare_rectangular_table
from tallyloom.plans.example import provide_example as provide_assembly_tool_example
from tallyloom.session import connection_guidance as display_connection_guidance
from tallyloom.sources.catalog import access_table as create_access_point
from tallyloom.sources.catalog import append_to_table as append_database_table
from tallyloom.sources.catalog import compress_table, create_table, create_view, delete_table, write_for_reuse
from tallyloom.sources.catalog import copy_local as copy_r_to_sql
from tallyloom.sources.catalog import has_required_columns as table_contains_required_columns
from tallyloom.sources.catalog import rewrite_clustered as create_nonclustered_index
from tallyloom.sources.catalog import save_plan as save_to_sql_script
from tallyloom.sources.catalog import table_or_view_exists as table_or_view_exists_in_db
from tallyloom.sources.catalog import write_table as write_to_database
from tallyloom.sources.files import read_table_file, write_results_csv

__all__ = sorted(n for n in globals() if not n.startswith("_") and n != "annotations")
