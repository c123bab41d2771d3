"""A small generated export of health records, in the eight source schemas."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

TS = pa.timestamp("us", tz="UTC")
CLASSES = "ambulatory emergency hospice home inpatient outpatient snf urgentcare virtual wellness".split()


def _at(day: date, hour: float) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc) + timedelta(hours=hour)


def write_export(folder: str, seed: int = 7, patients: int = 40, first: date = date(2025, 8, 1), days: int = 150) -> str:
    """Write the eight files; every day carries encounters, some near midnight. Returns the folder."""
    rng = random.Random(seed)
    people, spans, enc, cond, med, claims = [], [], [], [], [], []
    for p in range(patients):
        born = date(1950 + p, 3, 1 + p % 28) if p % 13 else first + timedelta(days=60 + p % 2)
        died = first + timedelta(days=100) if p % 11 == 5 else None
        people.append((f"p{p}", born, died, "F" if p % 2 else "M", "white", "hispanic" if p % 3 else "nonhispanic", f"town {p % 5}"))
        change = first + timedelta(days=90 + p % 20)
        moved = p % 4 == 0
        spans.append((f"p{p}", f"y{p % 3}", _at(date(1940, 1, 1), 0), _at(change if moved else date(2100, 1, 1), 0)))
        if moved:
            spans.append((f"p{p}", f"y{(p + 1) % 3}", _at(change, 0), _at(date(2100, 1, 1), 0)))
    for d in range(days):
        for k in range(3):
            n, who = len(enc), rng.randrange(patients)
            day = first + timedelta(days=d)
            start = _at(day, rng.choice([0.2, 9, 15, 23.7]))
            stop = start + timedelta(days=rng.randrange(6) if k == 0 else 0, hours=0.1)
            cost = round(rng.uniform(50, 9000), 2)
            cover = round(cost * rng.choice([0, 0.5, 0.8, 1]), 2)
            enc.append((f"e{n:05d}", start, stop, f"p{who}", "o1", f"d{n % 4}", f"y{who % 3}", "inpatient" if k == 0 else rng.choice(CLASSES), 185345009 + n % 5, "visit", 100.0, cost, cover, None, None))
            for c in range(rng.choice([0, 0, 1, 3])):
                own = day - timedelta(days=rng.choice([0, 0, 400]))
                cond.append((own, None, f"p{who}", f"e{n:05d}", "http://snomed.info/sct", 44054006 + c, "finding"))
            for c in range(rng.choice([0, 1, 2])):
                med.append((start + timedelta(days=rng.choice([0, 0, 3])), None, f"p{who}", f"y{who % 3}", f"e{n:05d}", 310798 + c, "drug", None, None, 1, 5.0, 5.0, 0.0))
            billed = day + timedelta(days=rng.choice([0, 0, 0, 2, 6, 40, 100]))
            for c in range(rng.choice([1, 1, 2, 5])):
                claims.append((f"c{n:05d}-{c}", f"p{who}", f"e{n:05d}", 1 + c % 2, start, _at(billed, 12)))
    s, f8, i64, i32, d32 = pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.date32()
    files = {
        "patients": (people, dict(Id=s, BIRTHDATE=d32, DEATHDATE=d32, GENDER=s, RACE=s, ETHNICITY=s, BIRTHPLACE=s)),
        "payer_transitions": (spans, dict(PATIENT=s, PAYER=s, START_DATE=TS, END_DATE=TS)),
        "encounters": (enc, dict(Id=s, START=TS, STOP=TS, PATIENT=s, ORGANIZATION=s, PROVIDER=s, PAYER=s, ENCOUNTERCLASS=s, CODE=i64, DESCRIPTION=s, BASE_ENCOUNTER_COST=f8, TOTAL_CLAIM_COST=f8, PAYER_COVERAGE=f8, REASONCODE=i64, REASONDESCRIPTION=s)),
        "conditions": (cond, dict(START=d32, STOP=d32, PATIENT=s, ENCOUNTER=s, SYSTEM=s, CODE=i64, DESCRIPTION=s)),
        "medications": (med, dict(START=TS, STOP=TS, PATIENT=s, PAYER=s, ENCOUNTER=s, CODE=i64, DESCRIPTION=s, REASONCODE=i64, REASONDESCRIPTION=s, DISPENSES=i64, BASE_COST=f8, TOTALCOST=f8, PAYER_COVERAGE=f8)),
        "providers": ([(f"d{k}", "o1", f"Dr {k}", "F", "GENERAL", "Town", "MA", "01234") for k in range(4)], {c: s for c in "Id ORGANIZATION NAME GENDER SPECIALITY CITY STATE ZIP".split()}),
        "payers": ([(f"y{k}", f"Payer {k}", "PRIVATE") for k in range(3)], {c: s for c in "Id NAME OWNERSHIP".split()}),
        "claims": (claims, dict(Id=s, PATIENTID=s, APPOINTMENTID=s, HEALTHCARECLAIMTYPEID1=i32, SERVICEDATE=TS, LASTBILLEDDATE1=TS)),
    }
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, (rows, types) in files.items():
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
        pq.write_table(pa.table({c: pa.array(v, t) for (c, t), v in zip(types.items(), columns, strict=True)}), f"{folder}/{name}.parquet", compression="zstd")
    return folder
