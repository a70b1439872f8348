"""Schemas of what the engine reads, keeps and returns."""

from __future__ import annotations

PARAM = "<*>"
#: Stands for a missing token in the keys of short lines.
PAD = "¦¦¦"

LINES = "log_index long, component string, level string, content string"
ASSIGNMENT = "log_index long, template_id long, template string"
TEMPLATES = "template_id long, component string, level string, template string, n_matched long"
PARAMETERS = "array<struct<value:string,mask_name:string>>"
LLM_RECORD = "array<struct<inputs:array<struct<Id:int,logs:string>>,output:array<struct<Id:int,Reason:string,template:string>>>>"
ONLINE_RESULT = "change_type string, cluster_id long, cluster_size long, template_mined string, total_cluster_count long"
METRICS = ("Dataset", "GA", "PA", "FGA", "FTA", "Dura", "#Line", "#Tpl", "#Invoke", "#Tokens", "Match", "Group", "Extract", "Correct")
