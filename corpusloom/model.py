"""Schemas of the code-corpus tables, and the values their enumerated columns take."""

from __future__ import annotations

#: Element types and kinds.
ELEMENT_TYPES = ("CLASS", "FUNCTION", "METHOD", "IMPORT", "MODULE", "VARIABLE", "EXPRESSION")
ELEMENT_KINDS = (
    "PACKAGE", "MODULE", "CLASS", "DATACLASS", "ENUM", "EXCEPTION", "NAMEDTUPLE", "FUNCTION", "METHOD", "CLASSMETHOD",
    "STATICMETHOD", "PROPERTY", "CONSTRUCTOR", "IMPORT", "FROM_IMPORT", "CONSTANT", "VARIABLE", "INSTANCE_VARIABLE", "CLASS_VARIABLE",
)

#: The texts of parse errors and of the modules that stand for unparsed files.
TOO_DEEP = "Maximum recursion depth exceeded: "
UNEXPECTED = "Unexpected error during parsing: "
UNDECODABLE = "Unicode decode error: "
ALL_FAILED = "All parsing approaches failed: "
STUB = "ERROR: This module could not be parsed.\nError type: {error_type}\nMessage: {message}\n"
STUB_LINE, STUB_COLUMN, STUB_CODE = "Location: Line ", ", Column ", "\nCode context:\n"

FILES = "path string, name string, size long, is_symlink boolean, content binary, skipped string"

PARAMETER = "struct<name:string,type_annotation:string,default_value:string,is_keyword_only:boolean,is_positional_only:boolean,is_variadic:boolean,description:string>"
SIGNATURE = f"struct<parameters:array<{PARAMETER}>,return_type:string,is_async:boolean,is_generator:boolean,is_abstract:boolean>"
_PAIRS = "array<struct<key:string,value:string>>"

#: What a parse task gives for each element; maps are arrays of entries until Spark has them. ``scope`` is the qualified name
#: of what the element stands in, and ``calls`` the names that it calls itself.
RAW_ELEMENT = (
    "struct<name:string,element_type:string,line_start:int,line_end:int,module_path:string,parent_name:string,docstring:string,"
    f"decorators:array<string>,signature:{SIGNATURE},bases:array<string>,methods:array<string>,attributes:{_PAIRS},"
    f"source_module:string,import_names:array<string>,import_aliases:{_PAIRS},is_from_import:boolean,depth_in_functions:int,is_mock:boolean,"
    "scope:string,calls:array<struct<name:string,line:int>>>"
)
RAW_ERROR = "struct<error_type:string,message:string,line:int,column:int,traceback:string,code_snippet:string>"
PARSED_WITH = f"file_path string, elements array<{{element}}>, error {RAW_ERROR}, fallback_level int, issues_found array<string>, sanitized_lines int"
PARSED = PARSED_WITH.format(element=RAW_ELEMENT)

#: The parts of RAW_ELEMENT that the narrow view reads, and those that links read.
COMPAT_ELEMENT = "struct<name:string,element_type:string,line_start:int,line_end:int,docstring:string,signature:struct<is_async:boolean>,depth_in_functions:int>"
LINKED_ELEMENT = (
    "struct<name:string,element_type:string,line_start:int,line_end:int,module_path:string,bases:array<string>,source_module:string,"
    f"import_names:array<string>,import_aliases:{_PAIRS},is_from_import:boolean,scope:string,calls:array<struct<name:string,line:int>>>"
)
