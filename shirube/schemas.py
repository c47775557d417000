"""Explicit schemas (DDL) of the tables; no read infers one."""
SOURCE = "struct<page:int,text:string,source_pdf:string,file_hash:string>"
PAGES = "file_hash string, page_no int, mode string, text string"
LINES = "file_hash string, page_no int, line_no int, text string, flags array<boolean>"
FIELD_ROWS = f"file_hash string, path string, value string, sources array<{SOURCE}>, needs_review boolean, confidence double"
DOCUMENTS = "document_id string, document_type string, building_id string, unit_id string, case_id string, title string, created_at timestamp"
VERSIONS = ("document_version_id string, document_id string, version_no int, source_type string, status string, is_current boolean, as_of_date date, "
            "file_hash string, original_filename string, import_key string, raw_json string, uploaded_at timestamp")
VALUES = ("extracted_value_id string, document_version_id string, field_code string, value_json string, confidence double, source_text string, source_article string, "
          "source_section string, page_no int, value_as_of_date date, needs_review boolean, reviewed boolean, approved boolean, created_at timestamp")
DIFFS = ("diff_id string, document_id string, old_version_id string, new_version_id string, field_code string, old_value_json string, new_value_json string, "
         "review_status string, affected_field string, reviewed_at timestamp, reviewed_by string")
LOTS = "array<struct<location:string,lot_number:string,land_category:string,area:decimal(18,4)>>"
FLOORS = "array<struct<floor:string,area:decimal(18,4)>>"
BUILDINGS = ("building_id string, building_name string, registry_location string, display_address string, property_type string, "
             f"building_structure string, land_lots {LOTS}, floor_areas {FLOORS}")
UNITS = ("unit_id string, building_id string, house_number string, unit_name string, unit_type string, unit_structure string, unit_floor string, "
         "registered_area decimal(18,4), built_date date, current_owner_name string, current_owner_address string, has_land_right boolean, land_right_type string, "
         "land_right_numerator decimal(38,0), land_right_denominator decimal(38,0), active_mortgages string, management_fee decimal(18,2), "
         "repair_reserve_fee decimal(18,2), updated_at timestamp")
CASES = "case_id string, unit_id string, case_status string, purchase_values map<string,string>, created_at timestamp, updated_at timestamp"
IMPORTS = "content_hash string, document_version_id string, raw_json string, created_at timestamp"
STORE = {"documents": DOCUMENTS, "versions": VERSIONS, "values": VALUES, "diffs": DIFFS, "buildings": BUILDINGS, "units": UNITS, "cases": CASES, "imports": IMPORTS}
JOB_EVENTS = "job_id string, event_id bigint, ts timestamp, status string, message string"
FILES = "job_id string, name string, file_hash string, size bigint"
