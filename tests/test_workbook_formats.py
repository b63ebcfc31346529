"""Versions of the workbook format, and columns typed by what they hold."""

import json
import math

import numpy as np
import pytest

from ratecraft.operators.fitted import FittedModel
from ratecraft.plans.tables import Axis, Model, Table
from ratecraft.sources.workbook import VERSION, Workbook, kind_by_content


def model():
    return FittedModel(Model([Table("intercept", "intercept", factors=np.array([0.5])), Table("x", "banded", (Axis("x", "band"),), [(1.0,), (math.inf,)], np.array([0.0, 0.25]))]))


@pytest.mark.parametrize("version", [1, VERSION])
def test_versions_that_can_be_read(tmp_path, version):
    path = tmp_path / "w.json"
    model().to_workbook().save_json(str(path))
    body = json.loads(path.read_text())
    assert body["manifest"]["format_version"] == VERSION
    body["manifest"]["format_version"] = version
    path.write_text(json.dumps(body))
    assert Workbook.load_json(str(path)).to_model().predict_one({"x": 5.0}) == pytest.approx(math.exp(0.75))


@pytest.mark.parametrize("version", [VERSION + 1, 999, 0, "2", None, True])
def test_versions_that_cannot(tmp_path, version):
    path = tmp_path / "w.json"
    model().to_workbook().save_json(str(path))
    body = json.loads(path.read_text())
    body["manifest"]["format_version"] = version
    path.write_text(json.dumps(body))
    with pytest.raises(ValueError, match="format version"):
        Workbook.load_json(str(path))
    model().to_workbook().save_csv_dir(str(tmp_path / "d"))
    (tmp_path / "d" / "manifest.json").write_text(json.dumps(body["manifest"]))
    with pytest.raises(ValueError, match="format version"):
        Workbook.load_csv_dir(str(tmp_path / "d"))


@pytest.mark.parametrize("values,labelled,kind", [
    ([1, 2, None], False, "category"), ([1, 2.5], False, "band"), (["1.5", "inf"], False, "band"), (["-inf", "NaN", 2], False, "band"), (["a", "b"], False, "label"), (["1", "2"], True, "label"), ([], False, "label"), ([True], False, "label"),
])
def test_kinds_by_content(values, labelled, kind):
    assert kind_by_content(values, labelled) == kind


def test_records_without_declared_kinds(tmp_path):
    path = tmp_path / "w.json"
    tables = [{"name": "base", "records": [{"Relativity": 2.0}]}, {"name": "t", "records": [{"age": "30", "region": "south", "code": 1, "Relativity": 1.5}, {"age": "inf", "region": "*", "code": 1, "Relativity": 3.0}]}]
    path.write_text(json.dumps({"manifest": {"scale": "relativity", "family": "poisson"}, "tables": tables}))
    m = Workbook.load_json(str(path)).to_model()
    assert [a.kind for a in m.model.tables[1].axes] == ["band", "category", "category"] and m.model.encodings == {"region": ["south"]}
    assert m.predict_one({"age": 20.0, "region": "south", "code": 1}) == pytest.approx(3.0)
    assert m.predict_one({"age": 20.0, "region": "north", "code": 1}) == pytest.approx(6.0)
