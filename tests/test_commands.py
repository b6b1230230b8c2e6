import json

import pytest
from pyspark.sql import functions as F

from rxflow.__main__ import main
from rxflow.functions import exprs as E
from rxflow.plans import runner


def raw_csv(path, n=40):
    rows = ["unmapped,rxn_idx,ec_num,organism,source,quality,natural,steps,protein_db,protein_refs"]
    rows += [f"C{'C' * (i % 9)}O>>C{'C' * (i % 5)}N,{i},{i % 3 + 1}.1,mouse,db,0.9,True,single,{'uniprot' if i % 4 else 'genbank'},\"['P{i % 6}']\"" for i in range(n)]
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_build_profile_and_drug_pairs(spark, tmp_path, capsys):
    seqs = spark.createDataFrame([(f"P{i}", "ACDEFGHIKLMN"[i:] * 4) for i in range(5)] + [("P05177", "MKLV")], "accession string, sequence string")
    seqs.write.parquet(str(tmp_path / "seqs"))
    resolved = tmp_path / "resolved.csv"
    resolved.write_text("ec_num,organism,n_accessions,accessions\n1.1,mouse,2,P0;P1\n2.1,mouse,0,\n")
    said = main(["build", raw_csv(tmp_path / "raw.csv"), str(tmp_path / "seqs"), str(tmp_path / "out"), "--resolved", str(resolved), "--set", "k=2", "--set", "fractions=0.6,0.2,0.2"], spark)
    manifest = json.loads(said)
    assert manifest["config"]["k"] == 2 and manifest["split"]["fractions"] == [0.6, 0.2, 0.2] and manifest["n_out"] == sum(manifest["per_split"].values()) > 0
    assert set(manifest["raw_sha256"]) == {"raw.csv", "resolved.csv"} and manifest["resolved_input"]["n_distinct_resolved_accessions"] == 2
    report = main(["profile", f"{tmp_path}/out/reactions", "--out", str(tmp_path / "report.txt")], spark)
    assert "sequence_length_histogram" in report and "#" * 40 in report and (tmp_path / "report.txt").read_text() == report
    pairs = tmp_path / "pairs.csv"
    pairs.write_text("pair_id,parent_smiles,metabolite_smiles,cyp,origin\n1,CCO,CC=O,CYP1A2,x\n2,CCO,CCN,other,x\n")
    made = json.loads(main(["drug-pairs", str(pairs), str(tmp_path / "seqs"), str(tmp_path / "drugs")], spark))
    assert made["n_out"] == 1 and made["n_dropped_unmapped_cyp"] == 1
    assert capsys.readouterr().out


def test_evaluate(spark, tmp_path):
    spark.createDataFrame([(0, ["CCO"], ["OCC", "C"])], "row_id long, references array<string>, predictions array<string>").write.parquet(str(tmp_path / "frame"))
    out = main(["evaluate", str(tmp_path / "frame"), "--name", "a run", "--runs", str(tmp_path / "runs")], spark)
    held = runner.load_run(out)
    assert held["metadata"]["device"]["cores"] == spark.sparkContext.defaultParallelism
    assert {m["name"]: m["value"] for m in held["metrics"]}["validity"] == 1.0


def test_presets():
    assert runner.configured("expanded").explode_all and runner.configured("smoke", ["seed=7", "explode_all=true", "threshold=0.5"]).seed == 7
    with pytest.raises(KeyError):
        runner.configured("none")
    with pytest.raises(KeyError):
        runner.configured("smoke", ["size=3"])
    with pytest.raises(SystemExit):
        main(["unknown"])


def test_architecture_of_a_predictor():
    class Weights:
        size = 12

    class Model:
        config = {"model_type": "t5", "d_model": 8}

        def parameters(self):
            return [Weights(), Weights()]

    got = runner.capture_architecture(Model(), "base")
    assert (got["base"], got["name"], got["n_parameters"], got["model_type"], got["num_heads"]) == ("base", "Model", 24, "t5", None)
    assert runner.capture_architecture(len)["n_parameters"] is None


def test_bars_and_cells(spark):
    assert runner.with_bars(["bin", "n"], [[0, 4], [1, 0], [2, 1]], width=4) == [["bin", "n", ""], [0, 4, "####"], [1, 0, ""], [2, 1, "#"]]
    assert runner.with_bars(["a", "b"], [[1, 2]]) == [["a", "b"], [1, 2]]
    row = spark.createDataFrame([(0.12345, 1234567), (None, None)], "x double, n long").select(E.cell(F.col("x")), E.readable(F.col("n"))).collect()
    assert [tuple(r) for r in row] == [("0.1235", "1,234,567"), ("—", None)]
