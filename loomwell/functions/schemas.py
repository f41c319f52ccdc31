"""Schemas of the source tables, and the rules that their loads keep."""

from __future__ import annotations

DEGRADERS = ["organism", "tax_id", "plastic", "reference", "enzyme_name", "enzyme_id", "db_enzyme_name", "gene", "genbank_id", "sequence", "year", "evidence", "plastic_used", "manufacturer", "analytical_grade", "thermophilic", "isolation_sample", "isolation_environment", "isolation_location", "extrapolated_from_enzyme", "enzyme_id_in_paper", "doi"]
TAXA = "biosample string, run_id string, taxon_id long, taxon_name string, self_count long, total_count long"
TRAITS = "taxon_id long, organism string, bacdive_found string, bacdive_temp_c string, bacdive_ph string, bacdive_oxygen string, bacdive_gram string, bacdive_morphology string"
SIGNALS = "orf_id long, top_signal short, signal_prob float, cleavage_pos short, cleavage_prob float"

#: Rules of the loads, as SQL: bits inside their range, probabilities, and statuses that agree with what is there.
SIGNAL_RULES = {
    "signal in 0 to 5": "top_signal between 0 and 5",
    "probability": "signal_prob between 0 and 1",
    "no signal, no cleavage": "(top_signal = 0) = (cleavage_pos is null)",
}
MASK_RULES = {"localization mask": "localization_mask between 1 and 1023", "membrane mask": "membrane_mask between 1 and 15"}
LENGTH_RULES = {"mature length": "not is_mature or sequence_length = full_sequence_length - cleavage_pos_used", "status": "(calc_status = 'ok') = (molecular_weight is not null)"}
