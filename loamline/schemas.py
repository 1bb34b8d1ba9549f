"""Table schemas.  The trace log's promoted properties are listed by type; column names follow a rule."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import types as T

#: Largest values of the unsigned types and what Spark type holds them.
UNSIGNED = {"u8": ((1 << 8) - 1, "smallint"), "u32": ((1 << 32) - 1, "bigint"), "u64": ((1 << 63) - 1, "bigint")}

# Fixed values.  An entry is a property key; ``column=Key`` where the column's name does not
# follow the rule; ``Key/Other`` for further spellings; ``@A,B`` limits it to events, and
# ``@*`` to those events that no other entry of the key names.
COMMON = "level process SessionID/Session transaction_id=Trans/TransactionID Usr AppID Interface Method@* sql/Sql planSQLText/PlanSQLText Dbms Database Dbpid DBCopy MDX DBConnID DBConnStr DBUsr Query Sdbl query_fields=QueryFileds/QueryFields Exception exception_descr=Descr exception_context=Context Func File@* Module OSException Locks Regions WaitConnections lka lkp lkpid lkaid lksrc DeadlockConnectionIntersections Server hResultOLEDB hResultNC2005 hResultNC2008 h_result_nc2012=hResult2012/hResultNC2012 seanceID ProcID ProcessName p_process_name=p:processName srcProcessName Finish RunAs MName IName RetExcp Host Val"
CLUSTER = "cluster_event=Event IB Ref DstAddr DstId DstSrv SrcAddr SrcId SrcSrv SrcURL MyVer SrcVer Registered Obsolete Released Reason Request ServiceName ApplicationExt NeedResync NewServiceDataDirectory OldServiceDataDirectory ServerComputerName procURL agentURL Admin Action MemoryLimits attn_info=Info@* attn_process_id=ProcessId attn_server_id=ServerId attn_url=Url lic_res=res HaspID Report"
SEARCH = "ftext_state=State ftext_files=Files ftext_folder=Folder ftext_time=Time ftext_file=File@FTEXTCHECK,FTEXTUPD ftext_info=Info@FTEXTCHECK,FTEXTUPD ftext_word=Word FindByString input_text=Text fts_job_id=jobId fts_log_from=logFrom fts_log_to=logTo fts_fixed_state=fixedState fts_table_name=tableName fts_table_code=tableCode fts_table_ref=tableRef fts_metadata_id=metaDataId fts_record_ref=recordRef fts_full_key=fullKey store_id=Id@* StorageGUID BackupFileName BackupBaseFileName UseMode sdgc_method=Method@SDGC"
SERVICES = "addin_classes=Classes addin_location=Location addin_method_name=MethodName addin_message=Message addin_source=Source addin_type=Type addin_error_descr=ErrorDescr system_class=Class system_component=Component system_file=File@SYSTEM system_txt=Txt eventlog_file_name=FileName video_connection=Connection@VIDEOCONN,VIDEOCALL,VIDEOSTATS video_status=Status@VIDEOCONN,VIDEOCALL,VIDEOSTATS video_stream_type=StreamType video_value=Value video_in_message=InMessage video_out_message=OutMessage video_direction=Direction vrs_uri=URI vrs_method=Method@VRSREQUEST,VRSRESPONSE vrs_headers=Headers vrs_phrase=Phrase@VRSRESPONSE sinteg_srvc_name=SrvcName sinteg_ext_srvc_url=ExtSrvcUrl sinteg_ext_srvc_usr=ExtSrvcUsr mail_message_uid=MessageUid mail_method=Method@MAILPARSEERR win_cert_certificate=certificate dhist_description=description t_application_name=t:applicationName t_computer_name=t:computerName"
SPEECH = "stt_id=Id@STT,STTAdm stt_key=Key stt_model_id=modelID stt_path=Path stt_audio_encoding=AudioEncoding stt_status=Status@STT,STTAdm stt_phrase=Phrase@* stt_rx_acoustic=rx:Acoustic stt_rx_grammar=rx:Grammar stt_rx_language=rx:Language stt_rx_location=rx:Location stt_rx_version=rx:Version stt_tx_acoustic=tx:Acoustic stt_tx_grammar=tx:Grammar stt_tx_language=tx:Language stt_tx_location=tx:Location stt_tx_version=tx:Version"
U64 = "ClientID connection_id=ConnID CallID Rows RowsAffected lkpto lkato Connection@* session_nmb=Nmb DstClientID Memory MemoryPeak Sz ExcessDurationSec FreeMemory TotalMemory SafeLimit AvMem MemoryUsed MinDataId ftext_files_total_size=FilesTotalSize findTicks ftextTicks fts_record_count=recordCount fts_total_records=totalRecords fts_skipped_records=skippedRecords store_size=Size MinimalWriteSize sdgc_instance_id=InstanceID sdgc_files_size=FilesSize sdgc_used_size=UsedSize sdgc_copy_bytes=CopyBytes sdgc_lock_duration=LockDuration eventlog_cpu_time=CpuTime vrs_body=Body t_client_id=t:clientID t_connect_id=t:connectID InBytes OutBytes duration_us=Durationus/Duration"
U32 = "OSThread NParams Line@* Port SyncPort PID Cluster Connections ConnLimit Infobases IBLimit DstPid SrcPid cn FailedJobsCount TotalJobsCount ftext_files_count=FilesCount ftext_sep_id=SepId ftextSearchCount ftextResultCount fts_table_count=tableCount fts_reindex_count=reindexCount fts_parallelism=parallelism system_line=Line@SYSTEM eventlog_packet_count=PacketCount video_cpu=cpu video_queue_length=QueueLenght stt_frames=Frames stt_contexts=Contexts stt_rx_sample_rate=rx:SampleRate stt_tx_sample_rate=tx:SampleRate vrs_status=Status@VRSRESPONSE win_cert_error_code=errorCode Calls"
U8 = "ftext_result=Result@FTEXTCHECK,FTEXTUPD BackupType addin_result=Result@ADDIN addin_crashed=Crashed Err"
FLAGS = "BackgroundJobCreated JobCanceledByLoadLimit ftext_separation=Separation SearchByMask tooManyResults FillRefsPresent ReadOnlyMode stt_contexts_only=ContextsOnly stt_recording=Recording"
TYPED = [("text", " ".join((COMMON, CLUSTER, SEARCH, SERVICES, SPEECH))), ("u64", U64), ("u32", U32), ("u8", U8), ("flag", FLAGS), ("i32", "ExitCode cnd"), ("i64", "Szd"), ("time", "ExcessStartTime")]
#: Keys that only some events promote but that are never kept among the other properties.
NEVER_KEPT = {"Result", "Status"}
#: Columns of the table that no property fills.
UNFILLED = {"video_type": "string", "conf_load_action": "string", "attn_pid": "bigint", "eventlog_os_thread": "bigint"}


def column_name(key: str) -> str:
    """The rule: words of a key in lower case, joined by underscores; a run of capitals is one word."""
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key)
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", parted).lower()


class Promoted(NamedTuple):
    column: str
    keys: tuple[str, ...]
    events: tuple[str, ...] | None
    elsewhere: bool
    kind: str


def _promoted() -> list[Promoted]:
    out = []
    for kind, entries in TYPED:
        for entry in entries.split():
            entry, _, events = entry.partition("@")
            column, _, keys = entry.rpartition("=")
            names = tuple(keys.split("/"))
            out.append(Promoted(column or column_name(names[0]), names, tuple(events.split(",")) if events and events != "*" else None, events == "*", kind))
    return out


PROMOTED = _promoted()
SPARK_TYPE = {"text": "string", "u64": "bigint", "u32": "bigint", "u8": "smallint", "flag": "smallint", "i32": "int", "i64": "bigint", "time": "timestamp"}

TECH_CORE = "ts timestamp, duration bigint, name string, depth smallint, cluster_guid string, cluster_name string, infobase_guid string, infobase_name string, raw_line string"
EVENT_LOG = (
    "event_time timestamp, event_date date, cluster_guid string, cluster_name string, infobase_guid string, infobase_name string, level string, event string, event_presentation string, "
    "user_name string, user_id string, computer string, application string, application_presentation string, session_id bigint, connection_id bigint, connection string, "
    "transaction_status string, transaction_id string, transaction_number bigint, transaction_datetime timestamp, data_separation string, metadata_name string, metadata_presentation string, "
    "comment string, data string, data_presentation string, server string, primary_port int, secondary_port int, props_key array<string>, props_value array<string>, record_hash string, comment_normalized string"
)
TECH_LOG = ", ".join([TECH_CORE, *(f"{p.column} {SPARK_TYPE[p.kind]}" for p in PROMOTED), *(f"{c} {t}" for c, t in UNFILLED.items()), "property_key array<string>", "property_value array<string>", "record_hash string", "raw_line_normalized string"])
PARSER_METRICS = (
    "timestamp timestamp, parser_type string, cluster_guid string, cluster_name string, infobase_guid string, infobase_name string, file_path string, file_name string, files_processed bigint, "
    "records_parsed bigint, parsing_time_ms bigint, records_per_second double, start_time timestamp, end_time timestamp, error_count bigint, file_reading_time_ms bigint, record_parsing_time_ms bigint, "
    "deduplication_time_ms bigint, writing_time_ms bigint, updated_at timestamp"
)
FILE_READING_PROGRESS = (
    "timestamp timestamp, parser_type string, cluster_guid string, cluster_name string, infobase_guid string, infobase_name string, file_path string, file_name string, file_size_bytes bigint, "
    "offset_bytes bigint, records_parsed bigint, last_timestamp timestamp, progress_percent double, updated_at timestamp"
)
#: Keys of the two bookkeeping tables, whose latest row counts.
FILE_KEY = ["parser_type", "cluster_guid", "infobase_guid", "file_path"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return struct(ddl).names
