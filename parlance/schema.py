"""Fixed schemas of the working grain (one row per message) and the export options."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK = "struct<type:string,text:string,language:string,markdown:string,url:string,alt:string,src:string,filename:string,data_url:string,mime_type:string>"
METADATA = "struct<timestamp:string,model:string,selector:string,index:int,visibleTextHash:string,providerMessageId:string,extractionMethod:string>"
#: A null metadata struct is an empty object, unlike a struct of nulls.
MESSAGES = f"conv_id long, msg_idx int, id string, role string, kind string, content array<{BLOCK}>, metadata {METADATA}"
SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class ExportOptions:
    """Constants of a plan; branches that are off are never built."""

    images: bool = True
    metadata: bool = True
    collapse_intermediate: bool = True
    anonymize_url: bool = False
    redact_secrets: bool = True
    use_provider_copy: bool = False
