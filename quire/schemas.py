"""Declared schemas; nothing is inferred from data."""

PAGE = "struct<n:int,chars:int,provider:string,conf:double,text:string>"
BATCH = f"path string, pages array<{PAGE}>"
VALIDATION = "struct<valid:boolean,value:string,errors:array<string>,normalized:string>"
RESULT = f"document_id string, fields map<string,string>, validation map<string,{VALIDATION}>, success boolean, confidence double, provider_chain array<string>, metadata map<string,string>"
CORRECTION = "correction_id string, ts timestamp, expected map<string,string>, detected map<string,string>, corrected map<string,string>, errors map<string,boolean>, source_document string, rois map<string,array<int>>"
ROI = "struct<top:double,bottom:double,left:double,right:double>"
FIELD_CONFIG = f"field string, roi {ROI}, preprocessing struct<threshold:string,blur_kernel:int,clahe:boolean>, min_confidence double, correction_rules array<struct<type:string,pattern:string>>"
OUTCOME = "seq long, ts timestamp, matches array<boolean>, manual boolean"
IMAGE = "struct<h:int,w:int,data:array<double>>"
