"""Schemas of pages, blocks and events. Offsets are code points; boxes are fractions of a page."""

BOX = "struct<x:double,y:double,w:double,h:double>"
ISSUE = "struct<id:string,kind:string,start:int,end:int,reason:string,resolved:boolean,replacement:string,inferred_text:string>"
BLOCK = (
    f"struct<id:string,type:string,order:int,bbox:{BOX},writing_mode:string,original:string,simplified:string,confidence:double,"
    f"uncertain:boolean,reviewed:boolean,heading_level:int,source:string,source_ids:array<string>,suggestion:string,issues:array<{ISSUE}>>"
)
PAGE = f"book_id string, page_number int, width double, height double, status string, revision int, blocks array<{BLOCK}>"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
