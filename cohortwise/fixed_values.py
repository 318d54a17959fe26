"""Codes, labels, weights and rules that results depend on.

Everything in this module is data.  Each table is the default of a parameter
somewhere in the library, so another cohort can bring its own.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Age bands, given by the lower bound of every band but the first
# --------------------------------------------------------------------------
AGE_CUTS_REPORT = (18, 30, 40, 50, 60, 70, 80, 90)
AGE_CUTS_GROUP = (18, 30, 40, 50, 60, 70, 80)
AGE_CUTS_STANDARD = (18, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90)

# --------------------------------------------------------------------------
# European Standard Population 2013 (public), total 100,000
# --------------------------------------------------------------------------
STANDARD_POPULATION = (
    ("<1", 1000.0),
    ("1-4", 4000.0),
    ("5-9", 5500.0),
    ("10-14", 5500.0),
    ("15-19", 5500.0),
    ("20-24", 6000.0),
    ("25-29", 6000.0),
    ("30-34", 6500.0),
    ("35-39", 7000.0),
    ("40-44", 7000.0),
    ("45-49", 7000.0),
    ("50-54", 7000.0),
    ("55-59", 6500.0),
    ("60-64", 6000.0),
    ("65-69", 5500.0),
    ("70-74", 5000.0),
    ("75-79", 4000.0),
    ("80-84", 2500.0),
    ("85-89", 1500.0),
    ("90+", 1000.0),
)
CHILD_BANDS = ("<1", "1-4", "5-9", "10-14")
SPLIT_BAND, SPLIT_SHARE = "15-19", 0.4
YOUNG_ADULT_BANDS, YOUNG_ADULT_BAND = ("15-19", "20-24"), "18-24"

# --------------------------------------------------------------------------
# Exact 95% Poisson limits divided by the count, for the counts
# (multiples of 5 below 100) that reach the Poisson branch
# --------------------------------------------------------------------------
POISSON_LIMITS = (
    (5, 0.324697, 2.333666),
    (10, 0.479539, 1.839036),
    (15, 0.559692, 1.649348),
    (20, 0.610826, 1.544419),
    (25, 0.647147, 1.476197),
    (30, 0.674696, 1.427562),
    (35, 0.696537, 1.390758),
    (40, 0.714415, 1.361716),
    (45, 0.729407, 1.338079),
    (50, 0.742219, 1.318375),
    (55, 0.753337, 1.301637),
    (60, 0.763105, 1.287198),
    (65, 0.771779, 1.274582),
    (70, 0.779549, 1.263440),
    (75, 0.786563, 1.253509),
    (80, 0.792938, 1.244587),
    (85, 0.798764, 1.236515),
    (90, 0.804118, 1.229170),
    (95, 0.809060, 1.222448),
)

# --------------------------------------------------------------------------
# Person columns, raw name -> engine name
# --------------------------------------------------------------------------
PERSON_COLUMNS = {
    "cen_pr_flag": "cen_pr_flag",
    "present_in_census": "present_in_census",
    "present_in_gpes": "present_in_gpes",
    "uresindpuk11_census": "uresindpuk11_census",
    "rgn_derived": "rgn_derived",
    "vaccine_number_1_vaccination_date_vacc": "first_vacc_date",
    "vaccine_number_2_vaccination_date_vacc": "second_vacc_date",
    "vaccine_number_3_vaccination_date_vacc": "third_vacc_date",
    "dob_census": "dob",
    "dod_deaths": "dod",
    "dor_deaths": "dor",
    "dodyr_deaths": "dodyr",
    "dodmt_deaths": "dodmt",
    "sex_census": "sex_census",
    "ethpuk11_census": "ethpuk11_census",
    "relpuk11_census": "relpuk11_census",
    "cob_census": "cob_census",
    "mainlangprf11_census": "mainlangprf11_census",
    "age_at_rollout_years_vacc": "age_when_eligible_years",
    "vaccine_number_1_gender_vacc": "gender_vacc",
    "hlqpuk11_census": "hlqpuk11_census",
    "disability_census": "disability_census",
    "care_home_pr19": "care_home_pr19",
    "nsshuk11_census": "nsshuk11_census",
    "tenhuk11_census": "tenhuk11_census",
    "rural_urban_derived": "rural_urban_derived",
    "lsoa_derived": "lsoa_derived",
}
DOSES = ("first", "second", "third")
LINK_FLAGS = ("cen_pr_flag", "present_in_census", "present_in_gpes")
COUNTRY_PREFIX = "E"

# --------------------------------------------------------------------------
# Programme dates
# --------------------------------------------------------------------------
DOSE_FLOORS = {"first": "2020-12-08", "second": "2020-12-08", "third": "2021-09-16"}
FIRST_PERIOD = (2020, 12)
AREA_FIRST_PERIOD = (2021, 4)
SECOND_DOSE_FIRST_PERIOD = (2021, 1)
THIRD_DOSE_FIRST_PERIOD = (2021, 11)
DEATH_REPORT_FLOOR = "2021-01-01"
EXPOSURE_MIN_AGE = {"education": 30}

# --------------------------------------------------------------------------
# Code -> label of the census characteristics
# --------------------------------------------------------------------------
ETHNICITY_LABELS = {
    "White British": (1,),
    "White other": (2, 3, 4),
    "Mixed": (5, 6, 7, 8),
    "Indian": (9,),
    "Pakistani": (10,),
    "Bangladeshi": (11,),
    "Chinese": (12,),
    "Black African": (14,),
    "Black Caribbean": (15,),
    "Other": (13,),
}
ETHNICITY_OTHER, ETHNICITY_OTHER_ABOVE = "Other", 15
RELIGION_LABELS = {
    "No religion": (1,),
    "Christian": (2,),
    "Buddhist": (3,),
    "Hindu": (4,),
    "Jewish": (5,),
    "Muslim": (6,),
    "Sikh": (7,),
    "Other Religion": (8,),
    "Religion Not Stated": (9,),
}
UK_BIRTH_CODES = ("921", "922", "923", "924", "925", "926")
LANGUAGE_LABELS = {
    "Main language": ("1",),
    "Not main language": ("2", "3", "4", "5"),
    "Not classified": ("X",),
}
EDUCATION_LABELS = {
    "No qualification": ("10",),
    "Level 1": ("11",),
    "Level 2": ("12",),
    "Apprenticeship": ("13",),
    "Level 3": ("14",),
    "Level 4+": ("15",),
    "Other": ("16",),
    "Not classified": ("XX",),
}
DISABILITY_LABELS = {
    "Limited a lot": ("1",),
    "Limited a little": ("2",),
    "Not Limited": ("3",),
}
OCCUPATION_RANGES = (
    (1, 4, "1 Higher managerial, administrative and professional occupations"),
    (4, 7, "2 Lower managerial, administrative and professional occupations"),
    (7, 8, "3 Intermediate occupations"),
    (8, 10, "4 Small employers and own account workers"),
    (10, 12, "5 Lower supervisory and technical occupations"),
    (12, 13, "6 Semi-routine occupations"),
    (13, 14, "7 Routine occupations"),
    (14, 15, "8 Never worked and long-term unemployed"),
)
OCCUPATION_UNCLASSIFIED = (15, 17)
TENURE_LABELS = {
    "Owned": ("0", "1"),
    "Social rented": ("3", "4"),
    "Private rented": ("5", "6", "7", "8"),
    "Other": ("2", "9"),
}
NOT_CLASSIFIED = "Not classified"
RURAL_URBAN_LABELS = {
    "Urban": ("A1", "B1", "C1", "A2", "B2", "C2"),
    "Rural": ("D1", "E1", "F1", "D2", "E2", "F2"),
}
REGION_LABELS = {
    "North East": ("E12000001",),
    "North West": ("E12000002",),
    "Yorkshire and The Humber": ("E12000003",),
    "East Midlands": ("E12000004",),
    "West Midlands": ("E12000005",),
    "East of England": ("E12000006",),
    "London": ("E12000007",),
    "South East": ("E12000008",),
    "South West": ("E12000009",),
}
SMALL_AREAS = {"Isles of Scilly": "Cornwall", "City of London": "Hackney"}

# --------------------------------------------------------------------------
# Characteristics counted by each call
# --------------------------------------------------------------------------
REGION_EXPOSURES = (
    "sex", "disability", "ethnicity", "religion", "country_of_birth", "language",
    "imd_quintile", "imd_quintile_region", "nssec_agg", "education", "tenure", "rural_urban",
)
AREA_EXPOSURES = (
    "sex", "disability", "country_of_birth", "language",
    "imd_quintile_la", "nssec_agg", "education", "tenure",
)
AREA_EXPOSURES_18_ONLY = ("tenure",)
SEX_EXPOSURES = (
    "disability", "ethnicity", "religion", "country_of_birth", "language",
    "imd_quintile", "nssec_agg", "education", "tenure", "rural_urban",
)

# --------------------------------------------------------------------------
# Secondary-disclosure rules, by minimum age of the run.
# One line is (doses, periods, exposure, groups, areas); None means any value.
# --------------------------------------------------------------------------
SUPPRESSION_RULES = {
    18: (
        (("second",), ((2021, 1), (2021, 2)), "ethnicity",
         ("Black Caribbean", "Bangladeshi"), ("North East", "East Midlands")),
        (("second",), ((2021, 1), (2021, 2)), "religion",
         ("Jewish", "Buddhist"), ("North East", "East Midlands")),
        (("first",), ((2020, 12),), "ethnicity",
         ("Black Caribbean", "Bangladeshi"), ("North East", "East Midlands")),
    ),
    50: (
        (None, None, "nssec_agg",
         ("Not classified", "8 Never worked and long-term unemployed"), ("Rutland", "Derby")),
        (("second",), ((2021, 8),), "language", None, ("Rutland", "Derby")),
        (("second",), ((2021, 1), (2021, 2)), "ethnicity",
         ("Black Caribbean", "Bangladeshi"), ("North East", "East Midlands", "South West")),
        (("second",), ((2021, 1), (2021, 2)), "religion",
         ("Jewish", "Buddhist"), ("North East", "East Midlands")),
        (("second",), ((2021, 1),), "tenure",
         ("Not classified", "Other"), ("North East", "East Midlands")),
        (("first",), ((2020, 12),), "ethnicity",
         ("Black Caribbean", "Bangladeshi"), ("North East", "East Midlands")),
    ),
}
SUPPRESSION_SEX = "Persons"
DISCLOSURE_LIMIT = 10

# --------------------------------------------------------------------------
# Published labels and texts
# --------------------------------------------------------------------------
EXPOSURE_TITLES = {
    "sex": "Sex",
    "age_group": "Age group",
    "disability": "Disability status",
    "ethnicity": "Ethnic group",
    "religion": "Religion",
    "country_of_birth": "Country of birth",
    "language": "English language proficiency",
    "imd_quintile": "Deprivation quintile",
    "imd_quintile_la": "Local authority deprivation quintile",
    "imd_quintile_region": "Regional deprivation quintile",
    "nssec_agg": "National Statistics Socio-economic classification",
    "education": "Educational attainment",
    "tenure": "Household tenure",
    "rural_urban": "Rural-urban",
}
THEME = "Vaccinations"
DOSE_PHRASES = {
    "first": "who have not received a vaccination",
    "second": "who have received two vaccinations",
    "third": "who have received three vaccinations",
}
INDICATOR_TEXT = "Cumulative {rate_type} percentage of people aged {min_age}+ {phrase}"
AXIS_TEXT = "{rate_type} percentage of people aged {min_age}+ {phrase} (%)"
GENERAL_FOOTNOTE = (
    "1. Figures based on vaccinations administered between 08 December 2020 and {period_end} "
    "for residents in England who could be linked to the 2011 Census and General Practice "
    "Extraction Service (GPES) Data for Pandemic Planning and Research (GDPPR).\n"
    "2. Therefore, these data only cover a subset of the population and should not be used to "
    "represent the total number of vaccinations. For this reason, these data may also differ "
    "from the administrative data on vaccinations published by NHS England weekly, which cover "
    "all vaccinations given to individuals who have an NHS number and are currently alive in "
    "the resident population."
)
AGE_FOOTNOTE = "3. These data only cover adults aged {min_age}+"
DEPRIVATION_FOOTNOTE = (
    "4. Index of Multiple Deprivation quintile was based on the English Index of Multiple "
    "Deprivation (IMD), version 2019. It was derived using the individual's resident address "
    "in the General Practice Extraction Service (GPES) Data for Pandemic Planning and Research. "
    "If this was not available, it was derived from the individual's resident address in the "
    "2011 Census"
)
CENSUS_FOOTNOTE = "4. {title} was derived from the 2011 Census"
TENURE_FOOTNOTE = (
    "4. Household tenure was derived from the 2011 Census. Not classified includes people living "
    "in communal establishments at the time of the 2011 Census."
)
OCCUPATION_FOOTNOTE = (
    "4. National Statistics Socio-economic classification was derived from the 2011 Census. Not "
    "classified includes full-time students, people with insufficient occupation information and "
    "people in communal establishments at the time of the 2011 Census."
)
AREA_FOOTNOTE = (
    "5. For statistical disclosure control purposes, Cornwall (E06000052) includes Isles of "
    "Scilly (E06000053), Hackney (E09000012) includes City of London (E09000001), and the time "
    "period starts from April 2021 for all local authority breakdowns."
)
EXPOSURE_FOOTNOTES = {
    "Deprivation quintile": DEPRIVATION_FOOTNOTE,
    "Regional deprivation quintile": DEPRIVATION_FOOTNOTE,
    "Local authority deprivation quintile": DEPRIVATION_FOOTNOTE,
    "Household tenure": TENURE_FOOTNOTE,
    "National Statistics Socio-economic classification": OCCUPATION_FOOTNOTE,
}
VALUE_NOTE = "NA"
