"""A session for all tests, and the six-row frame with values known by hand."""

from __future__ import annotations

import pytest

from loomwell.sessions import get_session

SIX = [
    ("Ideonella sakaiensis", 1547922, "PET", 2016, True, True, True, True, False, "Plastic waste", "Japan", "IsPETase", "MNFPRASRLMQAAVLGGLMAVGWSMGGGGS"),
    ("Ideonella sakaiensis", 1547922, "PHB", 2016, True, True, True, True, False, "Soil", "USA", "PHB depolymerase", "MKTAYIAKQRQISFVKSHFSRQDDEE"),
    ("Pseudomonas putida", 303, "LDPE", 2018, False, False, False, False, True, "Soil", "India", "", ""),
    ("Bacillus subtilis", 1423, "PET", 2020, True, True, True, True, False, "Compost", "Germany", "PETase", "MKFVKRGASLG"),
    ("Aspergillus niger", 5061, "LDPE", 2021, False, False, False, False, True, "Soil", "India", "", ""),
    ("Thermobifida fusca", 2061, "PET", 2012, True, True, True, True, False, "Compost", "Germany", "TfCut2", "MAVMTPRRERSSLLSRALQVTAAAATALVTA"),
]
NAMES = "organism string, tax_id long, plastic string, year int, has_sequence boolean, has_genbank boolean, has_enzyme boolean, analytical_grade boolean, extrapolated_from_enzyme boolean, isolation_environment string, isolation_location string, enzyme_name string, sequence string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = get_session("tests", "local[2]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{shared}/warehouse")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def six(spark):
    return spark.createDataFrame(SIX, NAMES)
