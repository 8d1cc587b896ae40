"""Entity schemas: field kinds, required-field messages and allowed codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KIND_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "longs": T.ArrayType(T.LongType()),
    "status": T.StringType(),
    "opinion_type": T.StringType(),
}

# ---------------------------------------------------------------------------
# Codes, column names, kinds and messages of the published bulk
# tables.  They have to be spelled exactly like this to read those files.
# ---------------------------------------------------------------------------

PRECEDENTIAL_STATUS = {
    "PUBLISHED": "Published",
    "UNPUBLISHED": "Unpublished",
    "ERRATA": "Errata",
    "SEPARATE": "Separate",
    "IN_CHAMBERS": "In-chambers",
    "RELATING_TO": "Relating-to",
    "UNKNOWN": "Unknown",
}

OPINION_TYPE = {
    "COMBINED": "010combined",
    "UNANIMOUS": "015unamimous",
    "LEAD": "020lead",
    "PLURALITY": "025plurality",
    "CONCURRENCE": "030concurrence",
    "CONCUR_IN_PART": "035concurrenceinpart",
    "DISSENT": "040dissent",
    "ADDENDUM": "050addendum",
    "REMITTUR": "060remittitur",
    "REHEARING": "070rehearing",
    "ON_THE_MERITS": "080onthemerits",
    "ON_MOTION_TO_STRIKE": "090onmotiontostrike",
    "TRIAL_COURT": "100trialcourt",
    "UNKNOWN": "999unknown",
}
UNKNOWN_OPINION_TYPE = "999unknown"

COURT_COLUMNS = """
    id:string full_name:string short_name:string jurisdiction:string position:double
    citation_string:string start_date:date end_date:date notes:string
"""
DOCKET_COLUMNS = """
    id:long court_id:string case_name:string docket_number:string date_created:timestamp
    date_modified:timestamp source:string appeal_from_id:string case_name_short:string
    case_name_full:string slug:string date_filed:date date_filed_is_approximate:bool
    date_terminated:date date_terminated_is_approximate:bool date_last_filing:date
    appeal_from_str:string assigned_to_str:string referred_to_str:string panel_str:string
    date_last_index:timestamp date_cert_granted:date date_cert_denied:date date_argued:date
    date_reargued:date date_reargument_denied:date docket_number_core:string cause:string
    nature_of_suit:string jury_demand:string jurisdiction_type:string federal_dn_case_type:string
    federal_dn_office_code:string federal_defendant_number:string
"""
CLUSTER_COLUMNS = """
    id:long docket_id:long date_created:timestamp date_modified:timestamp judges:string
    date_filed:date date_filed_is_approximate:bool slug:string case_name:string
    case_name_short:string case_name_full:string scdb_id:string scdb_decision_direction:string
    scdb_votes_majority:int scdb_votes_minority:int source:string procedural_history:string
    attorneys:string nature_of_suit:string posture:string syllabus:string headnotes:string
    summary:string disposition:string history:string other_dates:string cross_reference:string
    correction:string citation_count:int precedential_status:status date_blocked:date
    blocked:bool sub_opinions:longs
"""
OPINION_COLUMNS = """
    id:long cluster_id:long date_created:timestamp date_modified:timestamp type:opinion_type
    sha1:string page_count:int download_url:string local_path:string plain_text:string
    html:string html_lawbox:string html_columbia:string html_anon_2020:string
    xml_harvard:string html_with_citations:string extracted_by_ocr:bool author_id:long
    per_curiam:bool joined_by:longs
"""
CITATION_COLUMNS = """
    cited_opinion_id:long citing_opinion_id:long depth:int quoted:bool
    parenthetical_id:long parenthetical_text:string
"""
PERSON_COLUMNS = """
    id:long date_created:timestamp date_modified:timestamp name_first:string
    name_middle:string name_last:string name_suffix:string date_dob:date
    date_granularity_dob:string date_dod:date date_granularity_dod:string dob_city:string
    dob_state:string dod_city:string dod_state:string gender:string religion:string
    ftm_total_received:double ftm_eid:string has_photo:bool is_alias_of:long
"""

REQUIRED_MESSAGES = {
    "courts": {"id": "Court ID is required", "full_name": "Court full name is required"},
    "dockets": {
        "id": "Docket ID is required",
        "court_id": "Court ID is required",
        "case_name": "Case name is required",
        "docket_number": "Docket number is required",
    },
    "opinion_clusters": {
        "id": "Opinion Cluster ID is required",
        "docket_id": "Docket ID is required",
    },
    "opinions": {
        "id": "Opinion ID is required",
        "cluster_id": "Cluster ID is required",
        "type": "Opinion type is required",
    },
    "citations": {
        "cited_opinion_id": "Cited opinion ID is required",
        "citing_opinion_id": "Citing opinion ID is required",
        "depth": "Citation depth is required",
    },
    "people": {"id": "Person ID is required"},
}
NEGATIVE_DEPTH_MESSAGE = "Citation depth must be non-negative"

# Columns whose text feeds the full-text search of an entity.
SEARCH_TEXT_COLUMNS = {
    "courts": "full_name short_name jurisdiction citation_string notes",
    "dockets": "case_name case_name_short case_name_full docket_number source federal_dn_case_type",
    "opinion_clusters": "case_name case_name_short case_name_full judges procedural_history attorneys "
    "nature_of_suit posture syllabus headnotes summary disposition history",
    "opinions": "plain_text html sha1",
    "citations": "cited_opinion_id citing_opinion_id parenthetical_text",
    "people": "name_first name_middle name_last name_suffix dob_city dob_state dod_city dod_state "
    "gender religion",
}

# Positions of the older tab-separated line format; 12 to 18 need cleaning.
STANDARD_MAPPING = dict(
    enumerate(
        """id date_created date_modified date_filed case_number docket_number court_id court_name
        jurisdiction case_name case_type status plaintiff defendant attorney_plaintiff
        attorney_defendant judge notes tags description file_url""".split()
    )
)
MINIMAL_MAPPING = {
    0: "id",
    4: "case_number",
    7: "court_name",
    8: "jurisdiction",
    9: "case_name",
    10: "case_type",
}
CUSTOM_MAPPING = {
    0: "record_id",
    1: "case_id",
    2: "court_code",
    3: "filing_date",
    4: "case_title",
    5: "case_status",
}
CLEANED_POSITIONS = (12, 18)

# ------------------------------ end of fixed values -------------------------


@dataclass(frozen=True)
class Field:
    """One column of an entity."""

    name: str
    kind: str
    message: str | None = None  # set when the field is required
    aliases: tuple[str, ...] = ()
    default: object = None  # used when the parsed value is NULL

    @property
    def required(self) -> bool:
        return self.message is not None


@dataclass(frozen=True)
class Entity:
    """A table of the bulk data set: its fields, key and text columns."""

    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def text_columns(self) -> list[str]:
        return SEARCH_TEXT_COLUMNS[self.name].split()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KIND_TYPES[f.kind]) for f in self.fields])

    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType()) for f in self.fields])


_ALIASES = {("people", "is_alias_of"): ("is_alias_of_id",)}
_DEFAULTS = {
    ("courts", "position"): 0.0,
    ("courts", "jurisdiction"): "",
    ("opinion_clusters", "citation_count"): 0,
}


def _entity(name: str, columns: str, key: tuple[str, ...] = ("id",)) -> Entity:
    fields = []
    for column in columns.split():
        column_name, kind = column.split(":")
        default = _DEFAULTS.get((name, column_name))
        if default is None and kind == "bool":
            default = False
        fields.append(
            Field(
                column_name,
                kind,
                REQUIRED_MESSAGES[name].get(column_name),
                _ALIASES.get((name, column_name), ()),
                default,
            )
        )
    return Entity(name, tuple(fields), key)


ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        _entity("courts", COURT_COLUMNS),
        _entity("dockets", DOCKET_COLUMNS),
        _entity("opinion_clusters", CLUSTER_COLUMNS),
        _entity("opinions", OPINION_COLUMNS),
        _entity("citations", CITATION_COLUMNS, ("citing_opinion_id", "cited_opinion_id")),
        _entity("people", PERSON_COLUMNS),
    )
}


def entity(name: str | Entity) -> Entity:
    """Look an entity up, or take one that is not among the built-in ones as it is; an unknown name is an error."""
    if isinstance(name, Entity):
        return name
    try:
        return ENTITIES[name]
    except KeyError:
        raise ValueError(f"Unknown data type: {name}") from None
