"""Schemas of the document model. Order is data: block_no, line_no and pos are columns."""

from __future__ import annotations

BOX = "x0 double, y0 double, x1 double, y1 double"
SPAN = f"struct<text:string,size:double,flags:int,font:string,color:int,bbox:struct<{BOX.replace(' ', ':').replace(',:', ',')}>>"
RAW_BLOCKS = f"doc_id string, page_index int, block_no int, type int, bbox struct<{BOX.replace(' ', ':').replace(',:', ',')}>, lines array<struct<bbox:struct<{BOX.replace(' ', ':').replace(',:', ',')}>,spans:array<{SPAN}>>>"
PAGES = "doc_id string, page_index int, width double, height double"
TABLES = f"doc_id string, page_index int, {BOX}, col_count int, row_count int"
OBSTACLES = f"doc_id string, page_index int, source string, xref int, nth int, {BOX}"
RUN = "meta struct<label:string,pdf:string,pages:string,src:string,tgt:string,duration_s:double,date:string,n_blocks:int>, blocks array<struct<key:string,page:int,src:string,out:string>>"
EVENTS = "job string, kind string, current bigint, total bigint, text string"
