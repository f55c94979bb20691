"""Schemas of records and profiles."""

from __future__ import annotations

EXPERIENCE = "struct<company:string,title:string,start_date:string,end_date:string>"
EDUCATION = "struct<institution:string,degree:string,year:string>"

#: One row for each candidate in each source; record_id orders records, position is the place in its file.
RECORD = (
    "record_id bigint, source_type string, source_path string, position bigint, full_name string, emails array<string>, phones array<string>, location string, "
    f"skills array<string>, experience array<{EXPERIENCE}>, education array<{EDUCATION}>, current_company string, current_title string, links array<string>, raw_metadata string"
)

#: Type of a field's value in a profile.
VALUE = {
    "full_name": "string", "emails": "array<string>", "phones": "array<string>", "location": "string", "skills": "array<string>",
    "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "current_company": "string", "current_title": "string", "links": "array<string>",
}


def provenance_type(field: str) -> str:
    return f"struct<field:string,source_type:string,source_path:string,original_value:{VALUE[field]},method:string>"


def field_type(field: str) -> str:
    return f"struct<value:{VALUE[field]},confidence:double,provenance:array<{provenance_type(field)}>>"
