"""Declared schemas of all nested records; ids stay text."""

from __future__ import annotations

#: An exchange document as the parser gives it: null where an attribute or element is missing.
EXCHANGE_DOCUMENT = (
    "country string, doc_number string, kind string, status string, "
    "classifications array<struct<scheme:string,symbol:string>>, "
    "citations array<struct<cited:struct<country:string,number:string,kind:string>,categories:array<string>>>, "
    "family array<struct<format:string,id:struct<country:string,number:string,kind:string>>>, problem string"
)

PATENT_RECORD = "patent_id string, status string, cpc_list array<string>, citations array<struct<cited_id:string,categories:array<string>>>, family_patents array<string>"

TEXT_FIELDS = ("application_number", "publication_number", "patent_number", "title", "decision")
DATE_FIELDS = ("date_produced", "date_published", "filing_date", "patent_issue_date", "abandon_date")
CLASS_FIELDS = ("main_cpc_label", "cpc_labels", "main_ipcr_label", "ipcr_labels", "uspc_class", "uspc_subclass")
EXAMINER_FIELDS = ("examiner_id", "examiner_name_last", "examiner_name_first", "examiner_name_middle")
CONTENT_FIELDS = ("abstract", "claims", "background", "summary", "full_description")
INVENTOR = "struct<inventor_name_last:string,inventor_name_first:string,inventor_city:string,inventor_state:string,inventor_country:string>"

APPLICATION_JSON = ", ".join(
    [f"{n} {'array<string>' if n in ('cpc_labels', 'ipcr_labels') else 'string'}" for n in (*TEXT_FIELDS, *DATE_FIELDS, *CLASS_FIELDS, *EXAMINER_FIELDS, *CONTENT_FIELDS)]
    + [f"inventor_list array<{INVENTOR}>"]
)

CATALOG = (
    "id long, name string, deliveries array<struct<deliveryId:long,deliveryName:string,deliveryExpiryDatetime:string,"
    "items:array<struct<itemId:long,itemName:string,fileSize:string,fileChecksum:string,itemPublicationDatetime:string>>>>"
)

RELATIONS = "relations array<struct<e_1:string,rel:string,e_2:string>>"
