"""Workbooks: a model's tables as editable JSON or a folder of CSV files, with every fault named on the way back."""

from __future__ import annotations

import csv
import json
import math
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd

from ..operators.audit import Issue, check_table
from ..plans.tables import LINKS, UNSEEN, WILDCARD, Axis, Model, Table

#: The version written; this and all earlier ones can be read.
VERSION = 2
ANY = "*"


def table_from_frame(name: str, frame: pd.DataFrame, encodings: dict[str, list[str]] | None = None) -> Table:
    """Float columns are bands, integers codes; text columns are coded by ``encodings``, which grows by new labels."""
    axes, columns = [], []
    for c in [c for c in frame if c != "Rating_Factor"]:
        v = frame[c]
        if pd.api.types.is_float_dtype(v):
            axes.append(Axis(c, "band"))
            columns.append([float(x) for x in v])
        elif pd.api.types.is_integer_dtype(v):
            axes.append(Axis(c, "category"))
            columns.append([int(x) for x in v])
        else:
            if encodings is None:
                raise ValueError(f"column {c} of table {name} is {v.dtype}")
            labels = encodings.setdefault(c, [])
            labels += sorted({str(x) for x in v} - {ANY} - set(labels), key=str.encode)
            axes.append(Axis(c, "category"))
            columns.append([WILDCARD if str(x) == ANY else labels.index(str(x)) for x in v])
    keys = list(zip(*columns)) if columns else [()] * len(frame)
    kind = "intercept" if not axes else "interaction" if len(axes) > 1 else "banded" if axes[0].kind == "band" else "categorical"
    return Table(name, kind, tuple(axes), keys, frame["Rating_Factor"].to_numpy(float))


def _number(text: object) -> float:
    t = str(text).strip()
    return {"inf": math.inf, "-inf": -math.inf, "NaN": math.nan, "nan": math.nan}.get(t, None) if t in ("inf", "-inf", "NaN", "nan") else float(t)


def kind_by_content(values: list, labelled: bool) -> str:
    """What a column without a declared kind is: whole numbers are codes, numbers and their spellings bands, the rest labels."""
    own = [v for v in values if v is not None and v != ""]
    if own and all(isinstance(v, int) and not isinstance(v, bool) for v in own):
        return "category"
    if own and not labelled:
        try:
            [_number(v) for v in own]
            return "band"
        except ValueError:
            pass
    return "label"


def _readable(manifest: dict) -> dict:
    """The manifest, if its format version can be read; what early versions leave out is filled in."""
    version = manifest.get("format_version", manifest.get("version", 1))
    if not isinstance(version, int) or isinstance(version, bool) or not 1 <= version <= VERSION:
        raise ValueError(f"the workbook has format version {version}; versions 1 to {VERSION} can be read")
    return {"scale": "factor", "target": None, "exposure": None, "role": "none", "tweedie_power": 1.5, "encodings": {}, **manifest}


def _shown(v: object) -> object:
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else "inf" if v == math.inf else "-inf" if v == -math.inf else v
    return v


@dataclass
class Workbook:
    """Tables as (name, columns, rows) with a manifest; numbers are relativities or factors by ``scale``."""

    tables: list[tuple[str, list[str], list[list]]]
    manifest: dict
    notes: list[Issue] = field(default_factory=list)

    @property
    def scale(self) -> str:
        return self.manifest["scale"]

    @property
    def table_names(self) -> list[str]:
        return [t[0] for t in self.tables]

    @staticmethod
    def from_model(fitted, scale: str | None = None) -> "Workbook":
        m = fitted.model
        scale = scale or ("relativity" if m.link == "log" else "factor")
        if scale not in ("relativity", "factor"):
            raise ValueError("scale must be relativity or factor")
        if scale == "relativity" and m.link != "log":
            raise ValueError("relativities need a log link")
        tables, meta = [], []
        for t in m.tables:
            rows = []
            for k, f in zip(t.keys, t.factors):
                own = [m.encodings[a.name][v] if a.kind == "category" and a.name in m.encodings and 0 <= v < len(m.encodings[a.name]) else ANY if a.kind == "category" and v == WILDCARD and a.name in m.encodings else v for a, v in zip(t.axes, k)]
                rows.append([*own, math.exp(f) if scale == "relativity" else float(f)])
            tables.append((t.name, [*[a.name for a in t.axes], "Relativity" if scale == "relativity" else "Rating_Factor"], rows))
            meta.append({
                "name": t.name, "kind": t.kind, "axes": [[a.name, a.kind] for a in t.axes], "fixed": t.fixed, "locked": [i for i, x in enumerate(t.locked) if x], "locked_keys": [[_shown(x) for x in t.keys[i]] for i, y in enumerate(t.locked) if y],
                "degree": t.degree, "values": None if t.values is None else t.values.tolist(), "direction": t.direction, "knots": None if t.knots is None else t.knots.tolist(), "factors": t.factors.tolist(),
            })
        manifest = {"format_version": VERSION, "scale": scale, "family": m.family, "link": m.link, "target": m.target, "exposure": m.exposure, "role": m.role, "tweedie_power": m.tweedie_power, "encodings": m.encodings, "tables": meta}
        return Workbook(tables, manifest)

    @staticmethod
    def from_tables(tables: dict[str, pd.DataFrame], *, family: str, base_value: float, scale: str = "relativity", target: str | None = None, exposure: str | None = None, exposure_role: str = "weight", tweedie_power: float = 1.5) -> "Workbook":
        """A foreign tariff: text and integer columns are categories, floats bands; the last column holds the values."""
        from ..operators.fitted import FittedModel

        if scale == "relativity" and LINKS[family] != "log":
            raise ValueError("relativities need a log link")
        level = (lambda v: np.log(v)) if scale == "relativity" else (lambda v: v)
        if scale == "relativity" and not base_value > 0:
            raise ValueError("base_value must be positive")
        encodings: dict[str, list[str]] = {}
        made = [Table("intercept", "intercept", factors=np.array([float(level(base_value))]))]
        for frame in tables.values():
            for c in frame.columns[:-1]:
                if not pd.api.types.is_numeric_dtype(frame[c]):
                    labels = encodings.setdefault(c, [])
                    labels += list({str(x) for x in frame[c]} - {ANY} - set(labels))
        encodings = {c: sorted(v, key=str.encode) for c, v in encodings.items()}
        for name, frame in tables.items():
            value = frame.columns[-1]
            v = frame[value].to_numpy(float)
            if scale == "relativity" and not (v > 0).all():
                raise ValueError(f"table {name} has a relativity that isn't positive")
            made.append(table_from_frame(name, frame.drop(columns=value).assign(Rating_Factor=level(v)), encodings))
        faults = [f"{t.name}: {i.message}" for t in made[1:] for i in check_table(t)]
        if faults:
            raise ValueError("; ".join(faults))
        m = Model(made, family, LINKS[family], encodings, target, exposure, exposure_role if exposure else "none", tweedie_power)
        return Workbook.from_model(FittedModel(m), scale)

    def save_json(self, path: str) -> None:
        body = {"manifest": self.manifest, "tables": [{"name": n, "columns": c, "rows": [[_shown(v) for v in r] for r in rows]} for n, c, rows in self.tables]}
        Path(path).write_text(json.dumps(body, indent=1, ensure_ascii=False), encoding="utf-8")

    @staticmethod
    def load_json(path: str) -> "Workbook":
        """Tables are lists of rows under named columns, or lists of records whose last column holds the values."""
        body = json.loads(Path(path).read_text(encoding="utf-8"))
        tables = []
        for t in body["tables"]:
            columns = t["columns"] if "columns" in t else list(dict.fromkeys(c for r in t["records"] for c in r))
            tables.append((t["name"], columns, t["rows"] if "rows" in t else [[r.get(c) for c in columns] for r in t["records"]]))
        return Workbook(tables, _readable(body["manifest"]))

    def save_csv_dir(self, path: str) -> None:
        """``NN_name.csv`` for each table, and manifest.json."""
        top = Path(path)
        top.mkdir(parents=True, exist_ok=True)
        names = []
        for i, (name, columns, rows) in enumerate(self.tables):
            names.append(f"{i:02d}_{''.join(c if c.isalnum() or c in '-_.' else '_' for c in name)}.csv")
            with (top / names[-1]).open("w", newline="", encoding="utf-8") as f:
                out = csv.writer(f)
                out.writerow(columns)
                out.writerows([[repr(v) if isinstance(v, float) and math.isfinite(v) else _shown(v) for v in r] for r in rows])
        (top / "manifest.json").write_text(json.dumps({**self.manifest, "files": names}, indent=1, ensure_ascii=False), encoding="utf-8")

    @staticmethod
    def load_csv_dir(path: str) -> "Workbook":
        top = Path(path)
        manifest = _readable(json.loads((top / "manifest.json").read_text(encoding="utf-8")))
        tables = []
        for meta, name in zip(manifest["tables"], manifest["files"]):
            with (top / name).open(newline="", encoding="utf-8") as f:
                rows = [r for r in csv.reader(f) if r]
            for r in rows[1:]:
                if len(r) != len(rows[0]):
                    raise ValueError(f"{name} has a row of {len(r)} fields where {len(rows[0])} are named")
            tables.append((meta["name"], rows[0], rows[1:]))
        return Workbook(tables, manifest)

    def to_model(self):
        """Reads the tables back; all blocking faults are raised together, and what an edit undoes is noted."""
        from ..operators.fitted import FittedModel

        self.notes = []
        faults: list[str] = []
        encodings = {c: list(v) for c, v in self.manifest["encodings"].items()}
        made: list[Table] = []
        metas = self.manifest.get("tables") or [{"name": name} for name, _, _ in self.tables]
        link = self.manifest.get("link") or LINKS[self.manifest["family"]]
        for k, (meta, (name, columns, rows)) in enumerate(zip(metas, self.tables)):
            meta = {"kind": "given" if k else "intercept", "fixed": False, "locked_keys": [], "degree": 0, "values": None, "direction": None, "knots": None, "factors": [], **meta}
            if "axes" not in meta:
                kinds = [kind_by_content([r[j] for r in rows], c in encodings) for j, c in enumerate(columns[:-1])]
                for j, (c, kind) in enumerate(zip(columns, kinds)):
                    if kind == "label" and c not in self.manifest["encodings"]:
                        own = {str(r[j]) for r in rows if r[j] not in (None, "", ANY)}
                        encodings[c] = [*encodings.get(c, []), *sorted(own - set(encodings.get(c, [])), key=str.encode)]
                meta["axes"] = [[c, "band" if kind == "band" else "category"] for c, kind in zip(columns, kinds)]
            axes = tuple(Axis(n, kind) for n, kind in meta["axes"])
            keys, values = [], []
            for r in rows:
                key = []
                for a, v in zip(axes, r):
                    if v is None or v == "":
                        faults.append(f"{name}: null_{'bound' if a.kind == 'band' else 'level'}: {a.name} is empty in a row")
                        key.append(None)
                    elif a.kind == "band":
                        key.append(_number(v))
                    elif a.name in encodings:
                        if str(v) == ANY:
                            key.append(WILDCARD)
                        elif str(v) in encodings[a.name]:
                            key.append(encodings[a.name].index(str(v)))
                        else:
                            faults.append(f"{name}: unknown_level: {a.name} has no level {v}")
                            key.append(UNSEEN)
                    else:
                        key.append(int(v))
                keys.append(tuple(key))
                x = _number(r[-1])
                if self.scale == "relativity":
                    if not x > 0:
                        faults.append(f"{name}: non_positive_relativity: {x}")
                        x = 1.0
                    x = math.log(x)
                values.append(x)
            t = Table(name, meta["kind"], axes, keys, np.array(values, float), fixed=meta["fixed"], degree=meta["degree"], values=None if meta["values"] is None else np.array(meta["values"]), direction=meta["direction"], knots=None if meta["knots"] is None else np.array(meta["knots"]))
            faults += [f"{name}: {i.code}: {i.message}" for i in check_table(t, intercept=k == 0) if not (t.knots is not None and i.code == "no_unbounded_band")]
            self._review(t, meta)
            made.append(t)
        if faults:
            raise ValueError("; ".join(dict.fromkeys(faults)))
        g = self.manifest
        return FittedModel(Model(made, g["family"], link, encodings, g["target"], g["exposure"], g["role"], g["tweedie_power"]), notes=[f"{n.code}: {n.message}" for n in self.notes])

    def _review(self, t: Table, meta: dict) -> None:
        note = lambda c, m: self.notes.append(Issue("Medium", c, f"{t.name}: {m}"))
        if t.knots is not None:
            t.knots = np.array([k[0] for k in t.keys])
        if t.direction:
            d = np.diff(t.factors) * (1 if t.direction == "increasing" else -1)
            if (d < -1e-12).any():
                note("monotonicity_violated", "the factors no longer keep their direction")
                t.direction = None
        if t.degree:
            if len(t.values) != t.n:
                note("variate_dropped", "the rows changed, so it is a plain table now")
                t.degree, t.values = 0, None
            elif not np.allclose(t.factors, meta["factors"], rtol=0, atol=1e-9):
                note("variate_factors_edited", "the factors no longer are a polynomial of the values")
        locked = [tuple(WILDCARD if isinstance(v, str) and v == ANY else _number(v) if isinstance(v, str) else v for v in k) for k in meta["locked_keys"]]
        same = lambda a, b: all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))
        for k in locked:
            at = [i for i, own in enumerate(t.keys) if same(own, k)]
            if at:
                t.locked[at[0]] = True
            else:
                note("locked_row_missing", f"the locked row {k} is gone")
