"""Roles of the columns of process logs, by domain."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators import process
from sievemark.operators.text import repeated_narratives


@dataclass(frozen=True)
class Template:
    sources: tuple[str, ...]
    sinks: tuple[str, ...]
    tolerance_pct: float
    expected_seconds: float
    time_column: str
    narrative_column: str
    id_column: str


# Fixed values.
TEMPLATES = {
    "wastewater": Template(("influent_COD_kg_day", "influent_BOD_kg_day"), ("effluent_COD_kg_day", "effluent_BOD_kg_day", "sludge_COD_kg_day", "co2_emitted_kg_day_C"), 5.0, 3600.0, "sample_time", "operator_log", "report_date"),
    "waste_gas": Template(("inlet_VOC_mg_Nm3", "inlet_NOx_mg_Nm3", "inlet_SO2_mg_Nm3"), ("stack_VOC_mg_Nm3", "stack_NOx_mg_Nm3", "stack_SO2_mg_Nm3", "captured_in_scrubber_mg_Nm3"), 3.0, 1.0, "cem_timestamp", "shift_log", "cem_run_id"),
    "distillers_grain": Template(("wet_grain_in_kg", "added_water_kg", "enzyme_in_kg"), ("dried_DDGS_kg", "extracted_oil_kg", "evaporated_water_kg", "wastewater_kg"), 2.0, 86400.0, "batch_start", "batch_narrative", "batch_id"),
    "chemical": Template(("reactant_A_kg", "reactant_B_kg", "solvent_in_kg"), ("product_kg", "byproduct_kg", "waste_solvent_kg", "vent_gas_kg"), 1.0, 30.0, "dcs_timestamp", "batch_record", "batch_id"),
    "pharma": Template(("API_kg", "excipient_kg", "lubricant_kg"), ("finished_tablets_kg", "reject_kg", "in_process_loss_kg"), 0.5, 300.0, "batch_record_ts", "deviation_log", "lot_number"),
    "food": Template(("raw_ingredient_kg", "water_kg", "additive_kg"), ("finished_product_kg", "trim_waste_kg", "cleaning_loss_kg", "evaporated_water_kg"), 2.0, 900.0, "ccp_timestamp", "haccp_observation", "production_lot"),
    "semiconductor": Template(("wafers_in_count", "process_gas_kg_per_lot"), ("wafers_out_count", "yield_reject_count", "gas_vented_kg_per_lot"), 0.1, 1.0, "foup_timestamp", "recipe_deviation", "lot_id"),
    "environment": Template(("source_kg_yr", "import_kg_yr"), ("stack_emission_kg_yr", "wastewater_kg_yr", "land_disposal_kg_yr", "off_site_transfer_kg_yr"), 10.0, 2592000.0, "sample_date", "annual_report_section", "reporting_year"),
    "medical": Template(("drug_dispensed_count", "procedure_billed_count"), ("drug_administered_count", "procedure_recorded_count"), 0.0, 60.0, "emr_timestamp", "progress_note", "encounter_id"),
    "agriculture": Template(("seed_kg", "fertiliser_kg", "irrigation_m3"), ("yield_kg", "biomass_residue_kg", "spoilage_kg"), 15.0, 86400.0, "field_log_date", "field_observation", "plot_id"),
    "biopharma": Template(("feed_media_kg", "inoculum_kg", "antifoam_kg", "buffer_kg"), ("harvest_broth_kg", "spent_media_kg", "purified_product_kg", "process_waste_kg"), 0.5, 60.0, "bioreactor_ts", "ebmr_narrative", "campaign_lot"),
    "biocomputation": Template(("input_sample_volume_uL", "input_read_count_M"), ("output_library_volume_uL", "output_demuxed_reads_M", "qc_failed_reads_M", "unmapped_reads_M"), 2.0, 60.0, "run_start_ts", "pipeline_log", "run_id"),
}


def screen(log: DataFrame, domain: str, **changes) -> DataFrame:
    """I1, I2 and I5 over a log with file_id and row_id, by the domain's roles: file_id, detector_id, severity of each that applies."""
    t = replace(TEMPLATES[domain], **changes)
    have, parts = set(log.columns), []
    if have.issuperset(t.sources + t.sinks):
        parts.append(process.mass_balance(log, list(t.sources), list(t.sinks), t.tolerance_pct).select("file_id", F.lit("I1").alias("detector_id"), "severity"))
    if t.time_column in have:
        feed = log.select(F.col("file_id").alias("feed_id"), "row_id", F.col(t.time_column).cast("timestamp").alias("ts"))
        parts.append(process.timestamp_integrity(feed, t.expected_seconds).select(F.col("feed_id").alias("file_id"), F.lit("I2").alias("detector_id"), "severity"))
    if {t.narrative_column, t.id_column} <= have:
        pairs = repeated_narratives(log.select("file_id", F.col(t.id_column).alias("entry_id"), F.col(t.narrative_column).alias("narrative")))
        parts.append(pairs.groupBy("file_id").agg(F.max("severity").alias("severity")).select("file_id", F.lit("I5").alias("detector_id"), "severity"))
    if not parts:
        raise ValueError(f"the log has none of the columns of {domain}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("severity > 0")
