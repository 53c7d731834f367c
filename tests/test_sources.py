"""Readers and writers (S1-S4, S6-S8) on files written from the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from claimscope.sources import fixture as fx
from claimscope.sources import readers as RD


def test_csv_round_trip_with_schema(spark, sf_small):
    ip, _ = fx.inpatient_outpatient(spark, sf_small)
    out = os.path.join(tempfile.mkdtemp(prefix="claimscope-csv-"), "inpatient")
    cols = [f.name for f in RD.INPATIENT_SCHEMA.fields]
    RD.write_csv(ip.select(*cols), out)
    back = RD.read_csv(spark, out, RD.INPATIENT_SCHEMA)
    assert back.count() == ip.count()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, ip.select(*cols).collect()), key=str)
    inferred = RD.read_claims_csv(spark, out)
    assert dict(inferred.dtypes)["InscClaimAmtReimbursed"] in ("int", "bigint")


def test_code_lookup_reader_cleans_codes(spark):
    d = tempfile.mkdtemp(prefix="claimscope-icd-")
    p = os.path.join(d, "codes.txt")
    with open(p, "w", encoding="ISO-8859-1") as f:
        f.write("code\tlong\tshort\textra\n 401.9 \tHypertension\tHTN\tx\n250.00\tDiabète\t\ty\n")
    out = sorted(map(tuple, RD.read_code_lookup(spark, p).collect()), key=str)
    assert out == [("25000", "Diabète", None), ("4019", "Hypertension", "HTN")]


def test_roster_head_and_columns(spark, sf_small):
    d = tempfile.mkdtemp(prefix="claimscope-roster-")
    RD.write_csv(fx.roster(spark, sf_small), os.path.join(d, "roster"))
    roster = RD.read_roster(spark, os.path.join(d, "roster"))
    assert roster.count() == fx.roster(spark, sf_small).count()
    h = RD.head(fx.claims_full(spark, sf_small), 3, ["ClaimID", "Provider"])
    assert h.count() == 3
    prof = RD.columns(fx.claims_full(spark, sf_small))
    assert prof.count() == 54 and prof.where(F.col("column") == "PotentialFraud").first().type == "string"
