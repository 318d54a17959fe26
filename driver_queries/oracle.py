"""The same results in plain SQL for DuckDB, written the direct way.

Persons are expanded to person-months, every exposure is grouped on its own and
every table is summed on its own: no step is shared with the Spark plans except
the mapping of the driver tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from cohortwise import fixed_values as fv
from driver_queries.mapping import MARKED_LINE, duckdb_tables

PERIOD_END = "DATE '2023-01-31'"
YEARS = "CAST(365.25 AS DOUBLE)"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Sequence) -> str:
    return "(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + ")"


def band_case(age: str, cuts: Sequence[int]) -> str:
    parts = [f"WHEN {age} < {cuts[0]} THEN '<{cuts[0]}'"]
    parts += [
        f"WHEN {age} >= {lo} AND {age} < {hi} THEN '{lo}-{hi - 1}'" for lo, hi in zip(cuts, cuts[1:])
    ]
    parts.append(f"WHEN {age} >= {cuts[-1]} THEN '{cuts[-1]}+'")
    return "CASE " + " ".join(parts) + " END"


def code_case(code: str, labels: dict) -> str:
    parts = [f"WHEN {code} IN {in_list(codes)} THEN {quote(label)}" for label, codes in labels.items()]
    return "CASE " + " ".join(parts) + " END"


def age_on(day: str) -> str:
    return f"(datediff('day', dob, {day}) / {YEARS})"


LINKED = "(cen_pr_flag = 1 AND present_in_census = 1 AND present_in_gpes = 1)"
IN_COUNTRY = "(substr(rgn_derived, 1, 1) = 'E')"


def _person() -> str:
    dates = {"first_vacc_date", "second_vacc_date", "third_vacc_date"}
    columns = [
        f"CAST(try_strptime({old}, '%Y%m%d') AS DATE) AS {new}" if new in dates else f"{old} AS {new}"
        for old, new in fv.PERSON_COLUMNS.items()
    ]
    return f"SELECT {', '.join(columns)} FROM raw"


STATIC = f"""
SELECT * FROM person WHERE {LINKED} AND uresindpuk11_census = 1 AND {IN_COUNTRY}
AND (first_vacc_date IS NULL OR first_vacc_date >= DATE '2020-12-08')
AND (second_vacc_date IS NULL OR second_vacc_date >= DATE '2020-12-08')
AND (third_vacc_date IS NULL OR third_vacc_date >= DATE '2021-09-16')
"""


def _recodes() -> str:
    ethnicity = "TRY_CAST(ethpuk11_census AS DOUBLE)"
    religion = "TRY_CAST(relpuk11_census AS DOUBLE)"
    occupation = "TRY_CAST(nsshuk11_census AS DOUBLE)"
    ranges = " ".join(
        f"WHEN {occupation} >= {lo} AND {occupation} < {hi} THEN {quote(label)}"
        for lo, hi, label in fv.OCCUPATION_RANGES
    )
    labels = fv.ETHNICITY_LABELS
    first = {k: v for k, v in labels.items() if k != "Other"}
    return f"""
    CASE WHEN sex_census = '1' THEN 'Male' WHEN sex_census <> '1' THEN 'Female' END AS sex,
    coalesce({code_case(ethnicity, first)},
        CASE WHEN {ethnicity} > 15 OR {ethnicity} = 13 THEN 'Other' END) AS ethnicity,
    {code_case(religion, fv.RELIGION_LABELS)} AS religion,
    CASE WHEN cob_census IN {in_list(fv.UK_BIRTH_CODES)} THEN 'UK'
         WHEN cob_census IS NOT NULL THEN 'Non-UK' END AS country_of_birth,
    {code_case('mainlangprf11_census', fv.LANGUAGE_LABELS)} AS language,
    {code_case('hlqpuk11_census', fv.EDUCATION_LABELS)} AS education,
    {code_case('disability_census', fv.DISABILITY_LABELS)} AS disability,
    CASE WHEN care_home_pr19 IS NULL THEN 'No' ELSE 'Yes' END AS care_home,
    CASE {ranges} WHEN ({occupation} >= 15 AND {occupation} <= 17) OR {occupation} IS NULL
        THEN 'Not classified' END AS nssec_agg,
    CASE WHEN tenhuk11_census IS NULL THEN 'Not classified'
        ELSE {code_case('tenhuk11_census', fv.TENURE_LABELS)} END AS tenure,
    {code_case('rural_urban_derived', fv.RURAL_URBAN_LABELS)} AS rural_urban,
    {code_case('rgn_derived', fv.REGION_LABELS)} AS region
    """


QUINTILE = """
CASE WHEN imd_rank <= q[1] THEN '1' WHEN imd_rank > q[1] AND imd_rank <= q[2] THEN '2'
     WHEN imd_rank > q[2] AND imd_rank <= q[3] THEN '3'
     WHEN imd_rank > q[3] AND imd_rank <= q[4] THEN '4' WHEN imd_rank > q[4] THEN '5' END
"""
POINTS = "[CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE)]"


def _area_tables(postcodes: str, suffix: str = "") -> dict[str, str]:
    return {
        f"la_pairs{suffix}": "SELECT DISTINCT lsoa11, laua AS la_code, utla22nm AS la_name FROM "
        f"{postcodes} LEFT JOIN (SELECT DISTINCT * FROM la_names) ON laua = ltla22cd",
        f"la_units{suffix}": "SELECT LSOA11CD AS lsoa_derived, IMD_RANK AS imd_rank, la_code, la_name "
        f"FROM imd LEFT JOIN la_pairs{suffix} ON LSOA11CD = lsoa11",
        f"la_borders{suffix}": f"SELECT la_code, quantile_cont(imd_rank, {POINTS}) AS q "
        f"FROM la_units{suffix} GROUP BY la_code",
        f"area_la{suffix}": f"SELECT u.la_code, la_name, lsoa_derived, {QUINTILE} AS imd_quintile_la "
        f"FROM la_units{suffix} u LEFT JOIN la_borders{suffix} b ON u.la_code = b.la_code",
        f"rgn_units{suffix}": "SELECT LSOA11CD AS lsoa_derived, IMD_RANK AS imd_rank, rgn FROM imd "
        f"LEFT JOIN (SELECT DISTINCT lsoa11, rgn FROM {postcodes}) ON LSOA11CD = lsoa11",
        f"rgn_borders{suffix}": f"SELECT rgn, quantile_cont(imd_rank, {POINTS}) AS q "
        f"FROM rgn_units{suffix} GROUP BY rgn",
        f"area_rgn{suffix}": f"SELECT lsoa_derived, {QUINTILE} AS imd_quintile_region "
        f"FROM rgn_units{suffix} u LEFT JOIN rgn_borders{suffix} b ON u.rgn = b.rgn",
    }


MERGED = (
    "CASE la_name WHEN 'Isles of Scilly' THEN 'Cornwall' "
    "WHEN 'City of London' THEN 'Hackney' ELSE la_name END"
)


def _standard_values() -> str:
    return ", ".join(f"('{band}', {weight})" for band, weight in fv.STANDARD_POPULATION)


def base_tables() -> dict[str, str]:
    return {
        **duckdb_tables(),
        "person": _person(),
        "study": STATIC,
        "derived": f"SELECT *, {_recodes()} FROM study",
        **_area_tables("nspl"),
        "everyone": f"""
            SELECT derived.*, CAST(IMD_QUINTILE AS VARCHAR) AS imd_quintile, la_code,
                   imd_quintile_la, imd_quintile_region, {MERGED} AS la_derived
            FROM derived LEFT JOIN imd ON derived.lsoa_derived = LSOA11CD
            LEFT JOIN area_la ON derived.lsoa_derived = area_la.lsoa_derived
            LEFT JOIN area_rgn ON derived.lsoa_derived = area_rgn.lsoa_derived""",
        "months": "SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end, "
        "CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month "
        "FROM generate_series(DATE '2020-12-01', DATE '2023-01-01', INTERVAL 1 MONTH) AS t(m)",
        "esp_all": f"SELECT * FROM (VALUES {_standard_values()}) AS t(agegroup, w)",
        "esp": "SELECT CASE WHEN agegroup IN ('15-19', '20-24') THEN '18-24' ELSE agegroup END AS band, "
        "CAST(sum(CASE WHEN agegroup = '15-19' THEN w * 0.4 ELSE w END) AS DOUBLE) AS esp FROM esp_all "
        "WHERE agegroup NOT IN ('<1', '1-4', '5-9', '10-14') GROUP BY 1",
        "poisson": "SELECT deaths, CAST(l AS DOUBLE) AS l, CAST(u AS DOUBLE) AS u FROM (VALUES "
        + ", ".join(f"({d}, {lo}, {hi})" for d, lo, hi in fv.POISSON_LIMITS)
        + ") AS t(deaths, l, u)",
    }


def with_tables(select: str, extra: dict[str, str] | None = None) -> str:
    tables = {**base_tables(), **(extra or {})}
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in tables.items()) + "\n" + select


# ---------------------------------------------------------------- counts


def person_months(source: str, min_age: int) -> str:
    age = age_on("month_end")
    flags = ", ".join(
        f"CASE WHEN {d}_vacc_date <= month_end THEN 1 ELSE 0 END AS v_{d}" for d in fv.DOSES
    )
    return f"""
    SELECT *, {age} AS age, {band_case(age, fv.AGE_CUTS_GROUP)} AS age_group,
           {band_case(age, fv.AGE_CUTS_STANDARD)} AS age_group_esp, {flags}
    FROM {source}, months
    WHERE (dod IS NULL OR dod > month_end) AND {age} >= {min_age}"""


def counts_sql(exposures: Sequence[str], group_vars: Sequence[str], min_age: int) -> str:
    keys = "".join(f"{g}, " for g in group_vars)
    parts = []
    for exposure in exposures:
        low = max(30, min_age) if exposure == "education" else min_age
        for dose in fv.DOSES:
            parts.append(
                f"SELECT '{dose}' AS vaccine_number, year, month, '{exposure}' AS exposure, {keys}"
                f"CAST({exposure} AS VARCHAR) AS \"group\", count(*) AS population, "
                f"CAST(sum(v_{dose}) AS BIGINT) AS vaccinated FROM pm WHERE age >= {low} "
                f"GROUP BY year, month, {keys} {exposure}"
            )
    return " UNION ALL ".join(parts)


EXCLUDED = """NOT (year = 2020 AND vaccine_number <> 'first')
AND NOT (year = 2021 AND month NOT IN (11, 12) AND vaccine_number NOT IN ('first', 'second'))"""
FROM_APRIL = "year <> 2020 AND NOT (year = 2021 AND month IN (1, 2, 3))"


def counts_query(exposures, group_vars, min_age=18, source="derived", where="TRUE") -> str:
    return with_tables(
        f"SELECT * FROM counts WHERE {where}",
        {"pm": person_months(source, min_age), "counts": counts_sql(exposures, group_vars, min_age)},
    )


def call_tables(call, exposures, area, min_age, where="TRUE") -> dict[str, str]:
    """Counts of one call with exclusions, as table ``cnt_<call>``."""
    group_vars = ["age_group", "age_group_esp", area]
    if area == "sex":
        group_vars = ["age_group_esp", area]
    return {
        f"all_{call}": counts_sql(exposures, group_vars, min_age),
        f"cnt_{call}": f"SELECT *, {area} AS area FROM all_{call} WHERE {EXCLUDED} AND {where}",
    }


# ---------------------------------------------------------------- rates

# name -> (call, filter, exposure, group, sub category, sex, band or None for crude)
TABLES = {
    "total": ("region", "exposure = 'sex'", "'Total'", "'Total'", "'England'", None, True),
    "exposure": ("region", "exposure <> 'imd_quintile_region'", "exposure", '"group"', "'England'",
                 None, True),
    "region": ("region", "exposure = 'sex'", "'Total'", "'Total'", "area", None, True),
    "exposure_region": ("region", "exposure <> 'imd_quintile'", "exposure", '"group"', "area", None,
                        True),
    "age": ("region", "exposure = 'sex'", "'Total'", "'Total'", "age_group", None, False),
    "exposure_age": ("region", "exposure <> 'imd_quintile_region'", "exposure", '"group"',
                     "age_group", None, False),
    "region_age": ("region", "exposure = 'sex'", "'age_group'", "age_group", "area", None, False),
    "la": ("la", "exposure = 'sex'", "'Total'", "'Total'", "area", None, True),
    "la_exposure": ("la", "TRUE", "exposure", '"group"', "area", None, True),
    "la_age": ("la", "exposure = 'sex'", "'age_group'", "age_group", "area", None, False),
    "sex": ("sex", "TRUE", "exposure", '"group"', "'England'", "area", True),
}
RATES = ["crude_rate", "crude_lower_ci", "crude_upper_ci", "age_standardised_rate",
         "age_standardised_lower_ci", "age_standardised_upper_ci"]
KEYS = 'vaccine_number, year, month, exposure, "group", "SubCategory", "Sex"'


def rate_table_sql(name: str, table: tuple | None = None) -> dict[str, str]:
    call, where, exposure, group, sub, sex, standardise = table or TABLES[name]
    keys = f'vaccine_number, year, month, {exposure} AS exposure, {group} AS "group", {sub} AS sub, ' \
           f"{sex or 'CAST(NULL AS VARCHAR)'} AS sex"
    band = "age_group_esp" if standardise else "CAST(NULL AS VARCHAR)"
    t = f"t_{name}"
    out = {
        f"{t}_band": f"SELECT {keys}, {band} AS band, sum(population) AS p0, sum(vaccinated) AS v0 "
        f"FROM cnt_{call} WHERE {where} GROUP BY ALL",
        f"{t}_round": f"SELECT * EXCLUDE (p0, v0), round(p0 / 5.0) * 5 AS p, round((CASE WHEN "
        f"vaccine_number = 'first' THEN p0 - v0 ELSE v0 END) / 5.0) * 5 AS v FROM {t}_band",
    }
    if standardise:
        out[f"{t}_sum"] = f"""
        SELECT vaccine_number, year, month, exposure, "group", sub, sex,
            sum(p) AS p, sum(v) AS v, coalesce(sum(v / nullif(p, 0) * 100000 * esp), 0) AS std,
            coalesce(sum(pow(v / nullif(p, 0) * 100000, 2) / nullif(v, 0) * pow(esp, 2)), 0) AS var,
            sum(esp) AS w
        FROM {t}_round r LEFT JOIN esp e ON r.band = e.band GROUP BY ALL"""
    else:
        out[f"{t}_sum"] = f"SELECT * EXCLUDE (band), 0.0 AS std, 0.0 AS var, 0.0 AS w FROM {t}_round"
    crude = "(v / nullif(p, 0))"
    error = f"(1.96 * sqrt({crude} * (1 - {crude}) / nullif(p, 0)))"
    asr = "(std / nullif(w, 0))"
    avar = "(var / nullif(pow(w, 2), 0))"
    normal = f"1.96 * sqrt({avar})"
    scaled = f"sqrt({avar} / nullif(v, 0))"
    values = {
        "crude_rate": f"{crude} * 100",
        "crude_lower_ci": f"({crude} - {error}) * 100",
        "crude_upper_ci": f"({crude} + {error}) * 100",
        "age_standardised_rate": f"{asr} / 1000",
        "age_standardised_lower_ci": f"(CASE WHEN v >= 100 OR v = 0 THEN {asr} - {normal} "
        f"ELSE {asr} + (l * v - v) * {scaled} END) / 1000",
        "age_standardised_upper_ci": f"(CASE WHEN v >= 100 OR v = 0 THEN {asr} + {normal} "
        f"ELSE {asr} + (u * v - v) * {scaled} END) / 1000",
    }
    raw = ", ".join(f"{e} AS {n}" for n, e in values.items())
    clamps = []
    for n in RATES:
        e = n
        if n.endswith("lower_ci"):
            e = f"CASE WHEN {n} < 0 THEN 0 ELSE {n} END"
        if n.endswith("upper_ci"):
            e = f"CASE WHEN {n} > 100 THEN 100 ELSE {n} END"
        clamps.append(f"CAST({e} AS DOUBLE) AS {n}")
    out[f"{t}_rate"] = (
        f"SELECT r.*, {raw} FROM {t}_sum r LEFT JOIN poisson ON v = deaths"
    )
    if sex:
        embedded = 'exposure, "group", sub AS "SubCategory", sex AS "Sex"'
    else:
        embedded = (
            "CASE WHEN exposure = 'sex' THEN 'Total' ELSE exposure END AS exposure, "
            "CASE WHEN exposure = 'sex' THEN 'Total' ELSE \"group\" END AS \"group\", "
            "sub AS \"SubCategory\", "
            "CASE WHEN exposure = 'sex' THEN \"group\" ELSE 'Persons' END AS \"Sex\""
        )
    out[t] = (
        f"SELECT '{name}' AS \"table\", vaccine_number, year, month, {embedded}, "
        f"CAST(p AS BIGINT) AS population, CAST(v AS BIGINT) AS vaccinated, {', '.join(clamps)} "
        f"FROM {t}_rate"
    )
    return out


def rate_tables(names, calls, source="derived", min_age=18) -> dict[str, str]:
    """Table ``agg``: the union of some rate tables from the counts of ``calls``."""
    tables = {"pm": person_months(source, min_age)}
    for call, exposures, area in calls:
        where = FROM_APRIL if call == "la" else "TRUE"
        tables.update(call_tables(call, exposures, area, min_age, where))
    for name in names:
        tables.update(rate_table_sql(name))
    tables["agg"] = " UNION ALL ".join(f"SELECT * FROM t_{n}" for n in names)
    return tables


def rounded_rates(digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in RATES)


def rates_query(names, calls, source="derived", min_age=18) -> str:
    return with_tables(
        f"SELECT {KEYS}, population, vaccinated, {rounded_rates()} FROM agg",
        rate_tables(names, calls, source, min_age),
    )


SMALL = ("sex", "disability", "education", "rural_urban")
REGIONAL = (("total", "exposure", "region", "age", "region_age"), [("region", SMALL, "region")])


def suppressed(conditions: Sequence[str], source: str = "agg") -> str:
    bad = " OR ".join(
        f"coalesce({c}, FALSE)" for c in ["vaccinated < 10", "population - vaccinated < 10", *conditions]
    )
    blank = ", ".join(f"CASE WHEN NOT bad THEN {c} END AS {c}" for c in ["vaccinated", *RATES])
    return (
        f"SELECT \"table\", {KEYS}, population, {blank} FROM (SELECT *, ({bad}) AS bad FROM {source})"
    )


def rule_conditions(min_age: int) -> list[str]:
    """One condition per dose, month, group and area, spelled out."""
    out = []
    for doses, periods, exposure, groups, areas in fv.SUPPRESSION_RULES[min_age]:
        for dose in doses or (None,):
            for period in periods or (None,):
                for group in groups or (None,):
                    for area in areas:
                        parts = ["\"Sex\" = 'Persons'", f"exposure = {quote(exposure)}",
                                 f"\"SubCategory\" = {quote(area)}"]
                        if dose:
                            parts.append(f"vaccine_number = {quote(dose)}")
                        if period:
                            parts.append(f"year = {period[0]} AND month = {period[1]}")
                        if group:
                            parts.append(f'"group" = {quote(group)}')
                        out.append("(" + " AND ".join(parts) + ")")
    return out


def long_sql(source: str) -> str:
    bands = "('18-29', '30-39', '40-49', '50-59', '60-69', '70-79', '80+')"
    parts = []
    for kind in ("crude", "age_standardised"):
        where = "TRUE" if kind == "crude" else (
            "(exposure <> 'age_group' OR exposure IS NULL) "
            f"AND coalesce(\"SubCategory\" NOT IN {bands}, TRUE)"
        )
        parts.append(
            f"SELECT {KEYS}, '{kind}' AS rate_type, population, vaccinated, {kind}_rate AS rate, "
            f"{kind}_lower_ci AS lower_ci, {kind}_upper_ci AS upper_ci FROM {source} WHERE {where}"
        )
    return " UNION ALL ".join(parts)


def published_sql(source: str, min_age: int = 18) -> str:
    titles = " ".join(f"WHEN {quote(e)} THEN {quote(t)}" for e, t in fv.EXPOSURE_TITLES.items())
    phrases = {
        "first": "who have not received a vaccination",
        "second": "who have received two vaccinations",
        "third": "who have received three vaccinations",
    }
    kind = "replace(rate_type, '_', '-')"
    axis_kind = f"upper(substr({kind}, 1, 1)) || substr({kind}, 2)"

    def by_dose(start: str, end: str) -> str:
        return "CASE vaccine_number " + " ".join(
            f"WHEN '{d}' THEN {start} || ' percentage of people aged {min_age}+ {text}{end}'"
            for d, text in phrases.items()
        ) + " END"

    general = quote(fv.GENERAL_FOOTNOTE.format(period_end="31 January 2023"))
    notes = " ".join(
        f"WHEN {quote(t)} THEN {quote(n)}" for t, n in fv.EXPOSURE_FOOTNOTES.items()
    )
    return f"""
    SELECT *, indicator || coalesce(', by ' || title, '') AS chart,
        {general} || chr(10) ||
        CASE WHEN title = 'Educational attainment' THEN '3. These data only cover adults aged {max(30, min_age)}+'
             ELSE '3. These data only cover adults aged {min_age}+' END || chr(10) ||
        CASE WHEN title IS NULL THEN '' ELSE CASE title {notes}
             ELSE '4. ' || title || ' was derived from the 2011 Census' END END || chr(10) ||
        {quote(fv.AREA_FOOTNOTE)} AS footnote
    FROM (
        SELECT *, CASE exposure {titles} ELSE exposure END AS title,
            {by_dose("'Cumulative ' || " + kind, "")} AS indicator,
            {by_dose(axis_kind, " (%)")} AS axis,
            strftime(make_date(year, month, 1), '%b %Y') AS period
        FROM {source})"""


def _rates_source(select: str, extra: dict[str, str] | None = None) -> str:
    return with_tables(select, {**rate_tables(*REGIONAL), **(extra or {})})


def regional(select: str) -> str:
    return _rates_source(select)


def published(select: str) -> str:
    return _rates_source(
        select,
        {
            "safe": suppressed(rule_conditions(18)),
            "long": long_sql("safe"),
            "published": published_sql("long"),
        },
    )


DATASET = (
    "SELECT 'Vaccinations' AS \"Theme\", chart AS \"ChartTitle\", indicator AS \"IndDropdown\", "
    "period AS \"TimePeriodLabel\", title AS \"CategoryType\", \"group\" AS \"Category\", "
    "\"SubCategory\", \"Sex\", vaccinated AS \"Count\", population AS \"Denominator\", "
    "round(rate, 6) AS \"Value\", round(lower_ci, 6) AS \"LCI\", round(upper_ci, 6) AS \"UCI\" "
    "FROM published"
)
METADATA = (
    "SELECT DISTINCT chart AS \"ChartTitle\", axis AS \"yAxisLabel\", footnote AS \"Footnote\", "
    "'Linked person register' AS \"Source\" FROM published"
)


def in_order(sql: str, order: str) -> str:
    """A report with the place of each row."""
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position FROM ({sql})"


def run_tables(min_age: int) -> dict[str, str]:
    """All tables of a run, suppressed (``safe``)."""
    la = [e for e in fv.AREA_EXPOSURES if min_age == 18 or e != "tenure"]
    calls = [("region", fv.REGION_EXPOSURES, "region"), ("la", la, "la_derived"),
             ("sex", fv.SEX_EXPOSURES, "sex")]
    names = [n for n in TABLES if min_age == 18 or n not in ("age", "exposure_age", "region_age")]
    tables = rate_tables(names, calls, "everyone", min_age)
    return {**tables, "safe": suppressed(rule_conditions(min_age))}


def run_rows(min_age: int) -> str:
    return with_tables(
        f'SELECT "table", {KEYS}, population, vaccinated, {rounded_rates()} FROM safe',
        run_tables(min_age),
    )


def published_run(min_age: int, select: str) -> str:
    tables = {"long": long_sql("safe"), "published": published_sql("long", min_age)}
    return with_tables(select, {**run_tables(min_age), **tables})


def full_run(min_age: int) -> str:
    sums = ", ".join(f"round(sum({c}), 4) AS {c}" for c in RATES)
    return with_tables(
        f"""SELECT "table", vaccine_number, year, month, "Sex", count(*) AS "rows",
        count(vaccinated) AS published, CAST(sum(population) AS BIGINT) AS population,
        CAST(sum(vaccinated) AS BIGINT) AS vaccinated, {sums} FROM safe GROUP BY ALL""",
        run_tables(min_age),
    )


# ---------------------------------------------------------------- checks


def check_population(death: str | None, age_date: str | None, low=None, high=None) -> str:
    age = age_on(age_date) if age_date else "CAST(NULL AS DOUBLE)"
    where = [LINKED, IN_COUNTRY]
    if death:
        where.append(f"(dod IS NULL OR dod >= {death})")
    if low is not None:
        where.append(f"{age} >= {low}")
    if high is not None:
        where.append(f"{age} < {high}")
    return (
        f"SELECT *, substr(rgn_derived, 1, 1) AS country, {age} AS age FROM person "
        f"WHERE {' AND '.join(where)}"
    )


def dose_trend(people: str) -> str:
    parts = [
        f"SELECT '{d}' AS dose, {d}_vacc_date AS vacc_date, n, CAST(sum(n) OVER (ORDER BY "
        f"{d}_vacc_date NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_cum FROM "
        f"(SELECT {d}_vacc_date, count(*) AS n FROM people GROUP BY 1)"
        for d in ("first", "second")
    ]
    return with_tables(" UNION ALL ".join(parts), {"people": people})


def rate_by_age(people: str, cutoff: str | None) -> str:
    def share(dose: str) -> str:
        hit = f"{dose}_vacc_date IS NOT NULL" + (f" AND {dose}_vacc_date <= {cutoff}" if cutoff else "")
        return f"round(avg(CASE WHEN {hit} THEN 1.0 ELSE 0.0 END), 6) AS {dose}_rate"

    return with_tables(
        f"SELECT {band_case('age', fv.AGE_CUTS_REPORT)} AS age_group, count(*) AS n, "
        f"{share('first')}, {share('second')} FROM people GROUP BY 1",
        {"people": people},
    )


def missing(people: str) -> str:
    names = [*fv.PERSON_COLUMNS.values(), "country", "age"]
    parts = [
        f"SELECT '{n}' AS variable, CAST(count(*) - count({n}) AS BIGINT) AS missing FROM people"
        for n in names
    ]
    return with_tables(" UNION ALL ".join(parts), {"people": people})


def linkage(select: str) -> str:
    age = "age_when_eligible_years"
    linked = f"(present_in_gpes = 1 AND cen_pr_flag = 1 AND present_in_census = 1 AND {IN_COUNTRY})"
    people = f"""
    SELECT *, {band_case(age, fv.AGE_CUTS_REPORT)} AS age_group,
        coalesce(gender_vacc, 'Unknown') AS sex,
        CASE WHEN {linked} THEN 'Linked' WHEN NOT {linked} THEN 'Not linked' END AS linked
    FROM person WHERE (dod IS NULL OR dod >= {PERIOD_END})
    AND first_vacc_date <= {PERIOD_END} AND {age} >= 18"""
    return with_tables(select, {"people": people})


def linkage_wide(by: str, within: str) -> str:
    states = {"Linked": "linked = 'Linked'", "Not linked": "linked = 'Not linked'",
              "NA": "linked IS NULL"}
    columns = ", ".join(
        f"CAST(max(CASE WHEN {test} THEN n END) AS BIGINT) AS \"n_{s}\", "
        f"round(max(CASE WHEN {test} THEN share END), 6) AS \"proportion_{s}\""
        for s, test in states.items()
    )
    return linkage(
        f"SELECT {by}, {columns} FROM (SELECT linked, {by}, n, "
        f"n / sum(n) OVER (PARTITION BY {within}) * 100 AS share FROM "
        f"(SELECT linked, {by}, count(*) AS n FROM people GROUP BY ALL)) GROUP BY {by}"
    )


def grouped(source: str, *columns: str) -> str:
    keys = ", ".join(columns)
    return with_tables(f"SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}")


def band_query(cuts: Sequence[int]) -> str:
    return with_tables(
        f"SELECT {band_case(age_on(PERIOD_END), cuts)} AS band, count(*) AS n FROM person GROUP BY 1"
    )


RECODED = f"(SELECT *, {_recodes()} FROM person)"


#: Both limits by bisection: the mean at which the distribution function reaches the target.
POISSON = """
WITH RECURSIVE numbers AS (
  SELECT n, count(*) AS groups FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT count(*) FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT count(*) FROM lineitem GROUP BY l_suppkey, l_linenumber) GROUP BY n
), bisected AS (
  SELECT n, k, target, CAST(1e-9 AS DOUBLE) AS lo, CAST(n + 10 * sqrt(n) + 20 AS DOUBLE) AS hi, 0 AS step
  FROM (SELECT n, n - 1 AS k, 0.975 AS target FROM numbers UNION ALL SELECT n, n, 0.025 FROM numbers)
  UNION ALL
  SELECT n, k, target, CASE WHEN above THEN mid ELSE lo END, CASE WHEN above THEN hi ELSE mid END, step + 1
  FROM (
    SELECT *, list_sum(list_transform(range(0, k + 1),
             lambda i: exp(i * ln(mid) - mid - lgamma(i + 1)))) > target AS above
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisected WHERE step < 60))
)
SELECT n, any_value(groups) AS groups,
       round(max(CASE WHEN target > 0.5 THEN lo END) / n, 6) AS "L",
       round(max(CASE WHEN target < 0.5 THEN lo END) / n, 6) AS "U"
FROM bisected JOIN numbers USING (n) WHERE step = 60 GROUP BY n
"""
IMD_FIELDS = f"SELECT {MARKED_LINE['duckdb']} AS line, p_partkey % 40 AS mark FROM part"


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    deaths = found["deaths_by_month"]
    guarded = {"pm": person_months("derived", 18),
               "c": counts_sql(("disability",), ["age_group_esp", "region"], 18)}
    found |= {
        "shared_deaths_by_month": deaths,
        "shared_dose_trend": found["dose_trend_cumulative"],
        "shared_rate_by_age": found["rate_by_age"],
        "shared_missing_profile": found["missing_profile_all"],
        "shared_linkage_by_band": found["linkage_by_band_wide"],
        "incremental_month": counts_query(
            ("sex", "disability", "education"), ["age_group", "age_group_esp", "region"],
            where="year = 2023 AND month = 1"),
        "rate_guards": with_tables(
            "SELECT unnest(['weights_in.rows', 'weights_in.no_group', 'weights_out.rows', "
            "'weights_out.missing']) AS metric, unnest([count(*), count(*) FILTER (\"group\" IS NULL), "
            "count(*) + count(*) FILTER (age_group_esp = '30-34'), "
            "count(*) FILTER (age_group_esp IS NULL OR age_group_esp = '85-89')]) AS value FROM c",
            guarded),
        "fingerprinted_stage": f"SELECT *, unnest(CASE WHEN n >= 5 THEN [0, 1, 2] ELSE [0, 1] END) "
        f"AS asked FROM ({deaths})",
        "poisson_limits_exact": POISSON,
        "csv_good_rows": "SELECT split_part(line, ',', 1) AS \"LSOA11CD\", "
        "TRY_CAST(split_part(line, ',', 2) AS INT) AS \"IMD_RANK\", "
        f"CAST(split_part(line, ',', 3) AS INT) AS \"IMD_QUINTILE\" FROM ({IMD_FIELDS}) WHERE mark > 3",
        "csv_refused_lines": "SELECT line, CASE mark WHEN 2 THEN 'bad IMD_RANK' "
        "WHEN 3 THEN 'bad IMD_RANK, bad IMD_QUINTILE' ELSE 'wrong number of fields' END AS reason "
        f"FROM ({IMD_FIELDS}) WHERE mark <= 3",
        "bounded_period_files": f"SELECT \"TimePeriodLabel\", count(*) AS n, TRUE AS bounded, "
        f"TRUE AS in_order FROM ({found['publish_dataset']}) GROUP BY 1",
        "person_full_scan": with_tables(
            "SELECT count(*) AS n, " + ", ".join(f"count({c}) AS {c}" for c in fv.PERSON_COLUMNS)
            + " FROM raw"),
        "output_names": f"SELECT unnest(['deaths_2023_01_18+', 'deaths_2023_01_50+', "
        f"'deaths_2023_01_18+_v2']) AS name, count(*) AS n FROM ({deaths})",
    }
    return found


def _oracle_sql() -> dict[str, str]:
    age = age_on(PERIOD_END)
    no_age = check_population(PERIOD_END, None)
    adults = check_population(PERIOD_END, PERIOD_END, 18)
    half_away = "sign({0}) * trunc(abs({0}) * {1} + 0.5) / {1}"
    price = "(l_extendedprice - 50000)"
    region_small = [("region", SMALL, "region")]
    region_sex = [("region", ("sex",), "region")]
    la_sex = [("la", ("sex",), "la_derived")]
    borders = with_tables(
        "SELECT la_code, " + ", ".join(
            f"round(q[{i}], 6) AS imd_rank_p{i * 20}" for i in range(1, 5)
        ) + " FROM la_borders"
    )
    complement = "population - vaccinated"
    return {
        "monthly_total": rates_query(["total"], region_sex),
        "full_run_18": full_run(18),
        "full_run_50": full_run(50),
        "band_age_a": band_query(fv.AGE_CUTS_REPORT),
        "band_age_b": band_query(fv.AGE_CUTS_GROUP),
        "band_age_esp": band_query(fv.AGE_CUTS_STANDARD),
        "recode_case_when": grouped(RECODED, "religion", "language"),
        "recode_codes": grouped(RECODED, "education", "disability", "rural_urban"),
        "recode_numeric_ranges": grouped(RECODED, "ethnicity", "nssec_agg"),
        "recode_not_in_null": grouped(RECODED, "sex", "country_of_birth", "care_home", "tenure"),
        "recode_region": grouped(RECODED, "region"),
        "load_person_dates": with_tables(
            "SELECT last_day(first_vacc_date) AS month_end, count(*) AS n, "
            "min(second_vacc_date) AS second_from, max(third_vacc_date) AS third_to "
            "FROM person GROUP BY 1"
        ),
        "static_filter_nulls": with_tables(
            "SELECT rgn_derived, count(*) AS n, " + ", ".join(
                f"count({d}_vacc_date) AS n_{d}" for d in fv.DOSES
            ) + " FROM study GROUP BY 1"
        ),
        "age_window_counts": with_tables(
            "SELECT rgn_derived, count(*) AS n_none, "
            f"count(*) FILTER ({age} >= 18) AS n_low, count(*) FILTER ({age} < 50) AS n_high, "
            f"count(*) FILTER ({age} >= 18 AND {age} < 50) AS n_both FROM person GROUP BY 1"
        ),
        "month_expansion": with_tables(
            "SELECT year, month, count(*) AS n, count(dob) AS n_dob FROM person, months GROUP BY 1, 2"
        ),
        "registrations_by_month": with_tables(
            "SELECT TRY_CAST(substr(dor, 1, 4) AS DOUBLE) AS doryr, "
            "TRY_CAST(substr(dor, 5, 2) AS DOUBLE) AS dormt, count(*) AS n FROM person GROUP BY 1, 2"
        ),
        "registrations_by_day": with_tables(
            "SELECT dor, count(*) AS n FROM person WHERE dor IS NOT NULL AND dor >= '2021-01-01' "
            "GROUP BY 1"
        ),
        "deaths_by_month": with_tables(
            "SELECT TRY_CAST(dodyr AS DOUBLE) AS dodyr, TRY_CAST(dodmt AS DOUBLE) AS dodmt, "
            "count(*) AS n FROM person GROUP BY 1, 2"
        ),
        "deaths_by_day": with_tables(
            "SELECT dod, count(*) AS n FROM person WHERE dod IS NOT NULL "
            "AND dod >= DATE '2021-01-01' GROUP BY 1"
        ),
        "dose_trend_all": dose_trend(no_age),
        "dose_trend_cumulative": dose_trend(adults),
        "rate_by_age_any_date": rate_by_age(check_population(PERIOD_END, PERIOD_END), None),
        "rate_by_age": rate_by_age(
            check_population("DATE '2022-01-31'", PERIOD_END, 18, 90), "DATE '2022-01-31'"
        ),
        "missing_profile_all": missing(no_age),
        "missing_profile": missing(adults),
        "dose_trend_order": in_order(dose_trend(no_age), "dose, vacc_date NULLS LAST"),
        "rate_by_age_order": in_order(
            rate_by_age(check_population(PERIOD_END, PERIOD_END), None), "age_group NULLS LAST"
        ),
        "missing_profile_order": in_order(missing(no_age), "missing, variable"),
        "linkage_overall": linkage(
            "SELECT linked, n, round(n / sum(n) OVER () * 100, 6) AS proportion FROM "
            "(SELECT linked, count(*) AS n FROM people GROUP BY 1)"
        ),
        "linkage_by_band_wide": linkage_wide("age_group", "age_group"),
        "linkage_by_sex_wide": linkage_wide("sex", "sex"),
        "linkage_mean_age": linkage(
            "SELECT linked, round(avg(age_when_eligible_years), 6) AS mean_age FROM people GROUP BY 1"
        ),
        "linkage_dist_by_band_wide": linkage_wide("age_group", "linked"),
        "linkage_dist_by_sex_wide": linkage_wide("sex", "linked"),
        "area_percentiles": borders,
        "area_quintile_la": with_tables("SELECT * FROM area_la"),
        "area_quintile_region": with_tables("SELECT * FROM area_rgn"),
        "distinct_lookup": with_tables(
            "SELECT DISTINCT lsoa11, laua AS la_code, utla22nm AS la_name FROM nspl_split "
            "LEFT JOIN (SELECT DISTINCT * FROM la_names) ON laua = ltla22cd"
        ),
        "lookup_left_join_fanout": with_tables(
            "SELECT la_code, CAST(IMD_QUINTILE AS VARCHAR) AS imd_quintile, imd_quintile_la, "
            "imd_quintile_region, count(*) AS n FROM raw "
            "LEFT JOIN imd ON raw.lsoa_derived = LSOA11CD "
            "LEFT JOIN area_la_s ON raw.lsoa_derived = area_la_s.lsoa_derived "
            "LEFT JOIN area_rgn_s ON raw.lsoa_derived = area_rgn_s.lsoa_derived GROUP BY ALL",
            _area_tables("nspl_split", "_s"),
        ),
        "study_population_areas": grouped(
            "everyone", "la_derived", "imd_quintile", "imd_quintile_la", "imd_quintile_region"
        ),
        "merge_small_areas": with_tables(
            f"SELECT {MERGED} AS la_derived, count(*) AS n FROM la_units GROUP BY 1"
        ),
        "monthly_counts_region": counts_query(
            ("sex", "disability", "ethnicity", "religion"), ["age_group", "region"]
        ),
        "monthly_counts_area": counts_query(
            fv.AREA_EXPOSURES, ["age_group", "la_derived"], source="everyone",
            where=f"{EXCLUDED} AND {FROM_APRIL}",
        ),
        "monthly_counts_sex": counts_query(
            ("disability", "nssec_agg", "tenure", "rural_urban"), ["age_group_esp", "sex"]
        ),
        "monthly_counts_min_age_exposure": counts_query(
            ("education", "language"), ["age_group", "age_group_esp"]
        ),
        "monthly_counts_50": counts_query(("education", "sex"), ["age_group_esp"], 50),
        "monthly_counts_no_band": counts_query(("country_of_birth",), ["region", "sex"]),
        "monthly_counts_all": with_tables(
            " UNION ALL ".join(
                f"SELECT '{c}' AS call, vaccine_number, year, month, exposure, \"group\", "
                "CAST(sum(population) AS BIGINT) AS population, "
                f"CAST(sum(vaccinated) AS BIGINT) AS vaccinated FROM cnt_{c} GROUP BY ALL"
                for c in ("region", "la", "sex")
            ),
            {
                "pm": person_months("everyone", 18),
                **call_tables("region", fv.REGION_EXPOSURES, "region", 18),
                **call_tables("la", fv.AREA_EXPOSURES, "la_derived", 18, FROM_APRIL),
                **call_tables("sex", fv.SEX_EXPOSURES, "sex", 18),
            },
        ),
        "period_exclusions": counts_query(("sex",), ["age_group"], where=EXCLUDED),
        "standard_population": with_tables(
            'SELECT age_group_esp, n, round(esp, 6) AS "ESP" FROM (SELECT '
            f"{band_case(age, fv.AGE_CUTS_STANDARD)} AS age_group_esp, count(*) AS n FROM person "
            "GROUP BY 1) LEFT JOIN esp ON age_group_esp = band"
        ),
        "round_base5": "SELECT l_suppkey, count(*) AS n, CAST(round(count(*) / 5.0) * 5 AS BIGINT) "
        "AS n_rounded FROM lineitem GROUP BY 1",
        "round_half_away": "SELECT l_orderkey, l_linenumber, "
        + half_away.format(price, "CAST(1 AS DOUBLE)") + " AS whole, round("
        + half_away.format(price, "CAST(10 AS DOUBLE)") + ", 6) AS tenths FROM lineitem",
        "complement_first_dose": with_tables(
            "SELECT * REPLACE (CASE WHEN vaccine_number = 'first' THEN population - vaccinated "
            "ELSE vaccinated END AS vaccinated) FROM counts",
            {"pm": person_months("derived", 18), "counts": counts_sql(("sex",), [], 18)},
        ),
        "crude_rates": with_tables(
            "SELECT vaccine_number, year, month, \"group\", \"SubCategory\" AS age_group, population, "
            f"vaccinated, {rounded_rates()} FROM t_plain",
            {
                "pm": person_months("derived", 18),
                "counts": counts_sql(("disability",), ["age_group"], 18),
                **_plain("plain", "age_group", False),
            },
        ),
        "age_standardised_rates": with_tables(
            "SELECT vaccine_number, year, month, \"group\", population, "
            f"vaccinated, {rounded_rates()} FROM t_plain",
            {
                "pm": person_months("derived", 18),
                "counts": counts_sql(("region",), ["age_group_esp"], 18),
                **_plain("plain", "'x'", True),
            },
        ),
        "asr_care_home": rates_query(
            ["total", "exposure", "region", "exposure_region", "age", "exposure_age", "region_age"],
            [("region", ("care_home", "sex"), "region")],
        ),
        "asr_by_exposure": rates_query(["exposure"], region_small),
        "asr_by_region": rates_query(["region"], region_sex),
        "asr_exposure_region": rates_query(["exposure_region"], region_small),
        "asr_deprivation": rates_query(
            ["exposure", "exposure_region"],
            [("region", ("imd_quintile", "imd_quintile_region"), "region")], "everyone",
        ),
        "asr_by_sex": rates_query(["sex"], [("sex", ("disability", "education", "tenure"), "sex")]),
        "crude_by_age": rates_query(["age"], region_sex),
        "crude_exposure_age": rates_query(["exposure_age"], region_small),
        "crude_region_age": rates_query(["region_age"], region_sex),
        "la_total": rates_query(["la"], la_sex, "everyone"),
        "la_exposure": rates_query(
            ["la_exposure"], [("la", ("disability", "imd_quintile_la"), "la_derived")], "everyone"
        ),
        "la_age": rates_query(["la_age"], la_sex, "everyone"),
        "embed_sex": with_tables(
            "SELECT vaccine_number, year, month, population, vaccinated, "
            "CASE WHEN exposure = 'sex' THEN 'Total' ELSE exposure END AS exposure, "
            "CASE WHEN exposure = 'sex' THEN 'Total' ELSE \"group\" END AS \"group\", "
            "CASE WHEN exposure = 'sex' THEN \"group\" ELSE 'Persons' END AS \"Sex\" FROM counts",
            {"pm": person_months("derived", 18), "counts": counts_sql(("sex", "disability"), [], 18)},
        ),
        "union_tables": with_tables(
            "SELECT * FROM by_sex UNION ALL BY NAME SELECT * FROM by_region",
            {
                "pm": person_months("derived", 18),
                "by_sex": counts_sql(("sex",), [], 18),
                "by_region": counts_sql(("disability",), ["region"], 18),
            },
        ),
        "disclosure_counts": regional(
            'SELECT count(*) AS "rows", count(*) FILTER (vaccinated < 10) AS low_vaccinated, '
            f"count(*) FILTER ({complement} < 10) AS low_not_vaccinated FROM agg"
        ),
        "disclosure_by_month": regional(
            "SELECT 'vaccinated' AS \"check\", year, month, count(*) AS n FROM agg "
            "WHERE vaccinated < 10 GROUP BY ALL UNION ALL "
            "SELECT 'not_vaccinated', year, month, count(*) FROM agg "
            f"WHERE {complement} < 10 GROUP BY ALL"
        ),
        "disclosure_listing": regional(
            f"SELECT {KEYS}, population, vaccinated, {rounded_rates()} FROM agg WHERE vaccinated < 10"
        ),
        "disclosure_listing_complement": regional(
            f"SELECT {KEYS}, population, vaccinated, {rounded_rates()}, "
            f"{complement} AS not_vaccinated FROM agg WHERE {complement} < 10"
        ),
        "suppress_thresholds": _rates_source(
            f"SELECT {KEYS}, population, vaccinated, {rounded_rates()} FROM safe",
            {"safe": suppressed([])},
        ),
        "suppress_rules": with_tables(
            f"SELECT {KEYS}, population, vaccinated, {rounded_rates()} FROM safe",
            {
                **rate_tables(
                    ["exposure_region"], [("region", ("ethnicity", "religion"), "region")]
                ),
                "safe": suppressed(rule_conditions(18)),
            },
        ),
        "suppress_rules_50": with_tables(
            f"SELECT {KEYS}, population, vaccinated, {rounded_rates()} FROM safe",
            {
                **rate_tables(
                    ["la_exposure"], [("la", ("nssec_agg", "language"), "la_derived")],
                    "everyone", 50,
                ),
                "safe": suppressed(rule_conditions(50)),
            },
        ),
        "rates_long": regional(
            f"SELECT {KEYS}, rate_type, population, vaccinated, round(rate, 6) AS rate, "
            "round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci "
            f"FROM ({long_sql('agg')})"
        ),
        "publish_dataset": published(DATASET),
        "published_files": published(DATASET),
        "full_run_18_rows": run_rows(18),
        "full_run_50_rows": run_rows(50),
        "published_run_18": published_run(18, DATASET),
        "published_run_50": published_run(50, DATASET),
        "published_notes_50": published_run(50, METADATA),
        "person_table_scan": grouped("raw", "rgn_derived", "sex_census"),
        "csv_header_order": with_tables("SELECT * FROM imd"),
        "resumed_stage": with_tables(
            "SELECT dor, dodyr, dodmt, dod, count(*) AS n FROM person GROUP BY ALL"
        ),
        "publish_metadata": published(METADATA),
        "period_calendar": with_tables(
            "SELECT m.year, m.month, CAST(row_number() OVER (ORDER BY month_start) AS INT) AS position, "
            "strftime(month_start, '%b %Y') AS \"TimePeriodLabel\", coalesce(n, 0) AS n FROM months m "
            "LEFT JOIN (SELECT year(first_vacc_date) AS y, month(first_vacc_date) AS mo, "
            "count(*) AS n FROM person GROUP BY ALL) ON m.year = y AND m.month = mo"
        ),
    }


def _plain(name: str, sub: str, standardise: bool) -> dict[str, str]:
    """Rates of the operators used directly, which do not take the complement."""
    table = ("plain", "TRUE", "'x'", '"group"', sub, None, standardise)
    out = rate_table_sql(name, table)
    out["t_plain_round"] = (
        "SELECT * EXCLUDE (p0, v0), round(p0 / 5.0) * 5 AS p, round(v0 / 5.0) * 5 AS v "
        "FROM t_plain_band"
    )
    return {"cnt_plain": "SELECT * FROM counts", **out}
