"""SQL of the rule checks, written out: nothing here reads the rule rows.

A changed weight, label, pattern or condition in ``operators/rules.py`` disagrees with
these texts and turns the rule queries red.
"""

# Checker to rule set
RULE_SET = (
    "CASE checker "
    "WHEN 'BUFFER_SIZE' THEN 'BUFFER_SIZE' "
    "WHEN 'OVERRUN' THEN 'OVERRUN' "
    "WHEN 'OVERRUN_STATIC' THEN 'OVERRUN' "
    "WHEN 'OVERRUN_DYNAMIC' THEN 'OVERRUN' "
    "WHEN 'INTEGER_OVERFLOW' THEN 'INTEGER_OVERFLOW' "
    "WHEN 'STRING_NULL' THEN 'STRING_NULL' "
    "WHEN 'REVERSE_INULL' THEN 'REVERSE_INULL' "
    "WHEN 'FORWARD_NULL' THEN 'FORWARD_NULL' "
    "WHEN 'ARRAY_VS_SINGLETON' THEN 'ARRAY_VS_SINGLETON' "
    "WHEN 'NEGATIVE_RETURNS' THEN 'NEGATIVE_RETURNS' "
    "WHEN 'RESOURCE_LEAK' THEN 'RESOURCE_LEAK' "
    "WHEN 'DEADCODE' THEN 'DEADCODE' "
    "WHEN 'UNUSED_VALUE' THEN 'UNUSED_VALUE' "
    "WHEN 'UNINIT' THEN 'UNINIT' "
    "WHEN 'DIVIDE_BY_ZERO' THEN 'DIVIDE_BY_ZERO' "
    "WHEN 'USE_AFTER_FREE' THEN 'USE_AFTER_FREE' "
    "WHEN 'SIZEOF_MISMATCH' THEN 'SIZEOF_MISMATCH' "
    "WHEN 'CONSTANT_EXPRESSION_RESULT' THEN 'CONSTANT_EXPRESSION_RESULT' "
    "WHEN 'NO_BREAK' THEN 'NO_BREAK' "
    "WHEN 'SHIFT_OVERFLOW' THEN 'SHIFT_OVERFLOW' "
    "WHEN 'CHECKED_RETURN' THEN 'CHECKED_RETURN' "
    "WHEN 'CHECKED_QRS' THEN 'CHECKED_RETURN' "
    "ELSE 'GENERIC' END"
)

# Labels that decide by themselves
CRITICAL_BUG = [
    "strncpy_no_null_terminator",
    "unsafe_sink_function",
    "memcpy_without_size_guard",
    "trace_confirmed_oob",
    "trace_confirmed_null",
    "trace_confirmed_null_deref",
    "always_unsafe_sink",
    "taint_from_untrusted_source",
    "unsafe_sink",
    "early_return_without_release",
    "null_deref_confirmed",
]
CRITICAL_FP = [
    "guard_dominates_all_paths",
    "explicit_null_termination",
    "raii_smart_pointer",
    "null_guard_dominates_dereference",
    "null_guard_covers_all_paths",
    "safe_bounded_api_with_sizeof",
    "release_function_found",
    "preprocessor_disabled_block",
    "documented_fallthrough",
    "unsigned_wrap_defined_behavior",
    "upcast_to_wider_type",
    "explicit_range_guard",
    "sizeof_loop_bound",
    "constant_index_within_bounds",
    "loop_bounds_check_covers_all",
    "bounded_sink_function",
]

# Rules in order; those in LATER look at what the earlier ones have found
FIRST = [
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (defect_confirmed) THEN {'seq': 0, 'label': 'trace_confirmed_defect', 'polarity': 'bug', 'w': 30, 'text': 'the trace reports a defect on this path'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (taint_confirmed) THEN {'seq': 1, 'label': 'trace_confirmed_taint', 'polarity': 'bug', 'w': 25, 'text': 'the trace reports tainted data at the sink'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (guard_on_path AND guard_takes_true) THEN {'seq': 2, 'label': 'guard_confirmed_on_path', 'polarity': 'fp', 'w': 35, 'text': 'the trace passed a guard on its true branch'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (guard_on_path AND NOT guard_takes_true) THEN {'seq': 3, 'label': 'guard_present_uncertain', 'polarity': 'neutral', 'w': 0, 'text': 'the trace passed a guard of unknown outcome'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND ((instr(origin, 'network') > 0 OR instr(origin, 'args') > 0 OR instr(origin, 'env') > 0 OR instr(origin, 'file') > 0 OR instr(origin, 'caller-controlled') > 0 OR instr(origin, 'tainted') > 0 OR instr(origin, 'external') > 0)) THEN {'seq': 4, 'label': 'taint_from_untrusted_source', 'polarity': 'bug', 'w': 80, 'text': 'the value comes from ' || origin::VARCHAR} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND ((instr(origin, 'literal') > 0 OR instr(origin, 'local') > 0 OR instr(origin, 'bounded') > 0 OR instr(origin, 'safe') > 0) AND NOT (instr(origin, 'network') > 0 OR instr(origin, 'args') > 0 OR instr(origin, 'env') > 0 OR instr(origin, 'file') > 0 OR instr(origin, 'caller-controlled') > 0 OR instr(origin, 'tainted') > 0 OR instr(origin, 'external') > 0)) THEN {'seq': 5, 'label': 'taint_from_safe_source', 'polarity': 'fp', 'w': 60, 'text': 'the value comes from ' || origin::VARCHAR} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (instr(origin, 'alloc') > 0 AND NOT (instr(origin, 'literal') > 0 OR instr(origin, 'local') > 0 OR instr(origin, 'bounded') > 0 OR instr(origin, 'safe') > 0) AND NOT (instr(origin, 'network') > 0 OR instr(origin, 'args') > 0 OR instr(origin, 'env') > 0 OR instr(origin, 'file') > 0 OR instr(origin, 'caller-controlled') > 0 OR instr(origin, 'tainted') > 0 OR instr(origin, 'external') > 0)) THEN {'seq': 6, 'label': 'taint_from_allocation', 'polarity': 'bug', 'w': 65, 'text': 'the allocation may have returned NULL'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (guard_line > 0 AND guard_covers) THEN {'seq': 7, 'label': 'guard_dominates_all_paths', 'polarity': 'fp', 'w': 90, 'text': 'the guard at line ' || guard_line::VARCHAR || ' covers every path'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (guard_line > 0 AND NOT guard_covers) THEN {'seq': 8, 'label': 'guard_partial_coverage', 'polarity': 'neutral', 'w': 0, 'text': 'the guard at line ' || guard_line::VARCHAR || ' may be bypassed'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (guard_line > 0 AND guard_covers IS NULL) THEN {'seq': 9, 'label': 'guard_present', 'polarity': 'fp', 'w': 55, 'text': 'a guard stands at line ' || guard_line::VARCHAR} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets','sprintf','vsprintf')) THEN {'seq': 10, 'label': 'unsafe_sink_function', 'polarity': 'bug', 'w': 85, 'text': sink_func::VARCHAR || '() never checks its destination'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (sink_func IN ('strncpy','strncat','snprintf','strlcpy','strlcat','memcpy_s','strcpy_s')) THEN {'seq': 11, 'label': 'bounded_sink_function', 'polarity': 'fp', 'w': 85, 'text': sink_func::VARCHAR || '() takes a size'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (sink_func = 'memcpy') THEN {'seq': 12, 'label': 'memcpy_sink', 'polarity': 'bug', 'w': 60, 'text': 'memcpy() relies on the caller''s size'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (release_func <> '') THEN {'seq': 13, 'label': 'release_function_found', 'polarity': 'fp', 'w': 85, 'text': release_func::VARCHAR || '() is the matching release'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (release_func = '') AND regexp_matches(code, '\\bif\\s*\\(.*\\)\\s*\\{?\\s*return\\b') THEN {'seq': 14, 'label': 'early_return_without_release', 'polarity': 'bug', 'w': 80, 'text': 'an early return shows no release'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND regexp_matches(code, '\\bstd::unique_ptr|\\bstd::shared_ptr|\\bauto_ptr|\\bQScopedPointer|\\bg_auto') THEN {'seq': 15, 'label': 'raii_smart_pointer', 'polarity': 'fp', 'w': 90, 'text': 'a smart pointer owns the resource'} END",
    'CASE WHEN rule_set IN (\'BUFFER_SIZE\', \'OVERRUN\', \'INTEGER_OVERFLOW\', \'STRING_NULL\', \'REVERSE_INULL\', \'FORWARD_NULL\', \'RESOURCE_LEAK\', \'DEADCODE\', \'GENERIC\') AND regexp_matches(code, \'\\[\\s*(?:sizeof.*-\\s*1|\\w+\\s*-\\s*1)\\s*\\]\\s*=\\s*[\\"\'\']\\\\0[\\"\'\']\') THEN {\'seq\': 16, \'label\': \'explicit_null_termination\', \'polarity\': \'fp\', \'w\': 85, \'text\': \'the copy is terminated explicitly\'} END',
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND regexp_matches(code, '\\(\\s*(long long|int64_t|uint64_t|size_t)\\s*\\)') THEN {'seq': 17, 'label': 'upcast_to_wider_type', 'polarity': 'fp', 'w': 80, 'text': 'the operand is widened before the operation'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND regexp_matches(code, '\\bif\\s*\\(.*>\\s*(INT_MAX|UINT_MAX|0x7[Ff]+|32767|65535)\\)') THEN {'seq': 18, 'label': 'explicit_range_guard', 'polarity': 'fp', 'w': 90, 'text': 'the operand is compared with the type''s limit'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND regexp_matches(code, '#if 0|#ifdef NEVER') THEN {'seq': 19, 'label': 'preprocessor_disabled_block', 'polarity': 'fp', 'w': 95, 'text': 'the preprocessor leaves the code out'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND regexp_matches(code, '(?i)//\\s*fallthrough|/\\*\\s*fall.?through|FALLTHRU|FALLTHROUGH|\\[\\[fallthrough\\]\\]') THEN {'seq': 20, 'label': 'documented_fallthrough', 'polarity': 'fp', 'w': 90, 'text': 'the fall-through is marked as wanted'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (n_lines < 5) THEN {'seq': 21, 'label': 'insufficient_context', 'polarity': 'neutral', 'w': 0, 'text': 'only ' || n_lines::VARCHAR || ' lines of code are known'} END",
    "CASE WHEN rule_set IN ('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE', 'GENERIC') AND (corroborated_by <> '') THEN {'seq': 22, 'label': 'semgrep_confirms', 'polarity': 'bug', 'w': 45, 'text': 'rule ' || corroborated_by::VARCHAR || ' reports the same place'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func IN ('strncpy','strncat') AND (size_equal_in_trace OR size_equal_in_code OR (dest_size > 0 AND copy_size <> 0 AND copy_size >= dest_size))) THEN {'seq': 23, 'label': 'strncpy_no_null_terminator', 'polarity': 'bug', 'w': 85, 'text': sink_func::VARCHAR || '() may fill the whole destination'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND regexp_matches(code, '(?i)\\bstrncpy\\b|\\bstrncat\\b|\\bsnprintf\\b|\\bstrlcpy\\b') AND (regexp_matches(code, '(?i)sizeof\\s*\\([^)]*\\)\\s*-\\s*1') OR (guard_line > 0)) THEN {'seq': 24, 'label': 'safe_bounded_api_with_sizeof', 'polarity': 'fp', 'w': 70, 'text': 'the bounded call keeps room for the terminator'} END",
    'CASE WHEN rule_set = \'BUFFER_SIZE\' AND regexp_matches(code, \'(?i)\\[\\s*(?:sizeof.*-\\s*1|\\w+\\s*-\\s*1)\\s*\\]\\s*=\\s*[\\"\'\']\\\\0[\\"\'\']\') AND regexp_matches(code, \'(?i)\\bstrncpy\\b|\\bmemcpy\\b\') THEN {\'seq\': 25, \'label\': \'explicit_null_termination_after_copy\', \'polarity\': \'fp\', \'w\': 75, \'text\': \'the buffer is terminated after the copy\'} END',
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets') AND src_bounded) THEN {'seq': 26, 'label': 'unsafe_sink_but_bounded_source', 'polarity': 'fp', 'w': 55, 'text': 'the source of ' || sink_func::VARCHAR || '() is limited by sizeof'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets') AND NOT src_bounded) THEN {'seq': 27, 'label': 'always_unsafe_sink', 'polarity': 'bug', 'w': 75, 'text': sink_func::VARCHAR || '() has no visible limit'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func = 'sprintf') THEN {'seq': 28, 'label': 'sprintf_unbounded', 'polarity': 'bug', 'w': 60, 'text': 'sprintf() has no limit'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func = 'memcpy' AND memset_before) THEN {'seq': 29, 'label': 'memset_before_memcpy_cfg', 'polarity': 'fp', 'w': 65, 'text': 'the destination is zeroed before memcpy()'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func = 'memcpy' AND guard_line = 0) AND NOT regexp_matches(code, '(?i)sizeof\\s*\\(') THEN {'seq': 30, 'label': 'memcpy_without_size_guard', 'polarity': 'bug', 'w': 55, 'text': 'memcpy() has neither guard nor sizeof'} END",
    "CASE WHEN rule_set = 'BUFFER_SIZE' AND (sink_func = 'memcpy') AND (regexp_matches(code, '(?i)sizeof\\s*\\(') OR (guard_line > 0)) THEN {'seq': 31, 'label': 'memcpy_with_size_guard', 'polarity': 'fp', 'w': 50, 'text': 'the size of memcpy() looks limited'} END",
    "CASE WHEN rule_set = 'INTEGER_OVERFLOW' AND regexp_matches(code, '(?i)\\buint(8|16|32|64)_t\\b|\\bunsigned\\b') AND NOT regexp_matches(code, '(?i)\\b(signed|int32_t|int64_t)\\b') THEN {'seq': 32, 'label': 'unsigned_wrap_defined_behavior', 'polarity': 'fp', 'w': 60, 'text': 'unsigned arithmetic wraps by definition'} END",
    'CASE WHEN rule_set = \'STRING_NULL\' AND (sink_func IN (\'memcpy\',\'strncpy\')) AND NOT regexp_matches(code, \'(?i)[\\"\'\']\\\\0[\\"\'\']\') THEN {\'seq\': 33, \'label\': \'copy_without_null_termination\', \'polarity\': \'bug\', \'w\': 65, \'text\': sink_func::VARCHAR || \'() is not followed by a terminator\'} END',
    "CASE WHEN rule_set = 'REVERSE_INULL' AND (null_guard_line > 0 AND null_guard_covers AND null_guard_before) THEN {'seq': 34, 'label': 'null_guard_dominates_dereference', 'polarity': 'fp', 'w': 75, 'text': 'the check at line ' || null_guard_line::VARCHAR || ' covers the use'} END",
    "CASE WHEN rule_set = 'REVERSE_INULL' AND (null_var <> '' AND null_var = var) THEN {'seq': 35, 'label': 'trace_confirmed_null', 'polarity': 'bug', 'w': 85, 'text': 'the trace shows `' || var::VARCHAR || '` is NULL'} END",
    "CASE WHEN rule_set = 'FORWARD_NULL' AND (null_guard_line > 0 AND null_guard_covers) THEN {'seq': 36, 'label': 'null_guard_covers_all_paths', 'polarity': 'fp', 'w': 75, 'text': 'the check at line ' || null_guard_line::VARCHAR || ' covers the use'} END",
    "CASE WHEN rule_set = 'FORWARD_NULL' AND (null_guard_line > 0 AND null_guard_inside) THEN {'seq': 37, 'label': 'cfg_call_inside_guard_block', 'polarity': 'fp', 'w': 80, 'text': 'the use stands inside the checked block'} END",
    "CASE WHEN rule_set = 'FORWARD_NULL' AND (guarded_by_flag) THEN {'seq': 38, 'label': 'guarded_call_success_flag', 'polarity': 'fp', 'w': 75, 'text': 'the use is reached only after a success flag'} END",
    "CASE WHEN rule_set = 'FORWARD_NULL' AND (null_var <> '' AND null_var = var) THEN {'seq': 39, 'label': 'trace_confirmed_null_deref', 'polarity': 'bug', 'w': 90, 'text': 'the trace shows `' || var::VARCHAR || '` is NULL'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bfclose\\s*\\(') THEN {'seq': 40, 'label': 'release_function_fclose', 'polarity': 'fp', 'w': 75, 'text': 'fclose() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bclose\\s*\\(') THEN {'seq': 41, 'label': 'release_function_close', 'polarity': 'fp', 'w': 75, 'text': 'close() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bfree\\s*\\(') THEN {'seq': 42, 'label': 'release_function_free', 'polarity': 'fp', 'w': 75, 'text': 'free() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bdelete\\s*\\(') THEN {'seq': 43, 'label': 'release_function_delete', 'polarity': 'fp', 'w': 75, 'text': 'delete() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bCloseHandle\\s*\\(') THEN {'seq': 44, 'label': 'release_function_CloseHandle', 'polarity': 'fp', 'w': 75, 'text': 'CloseHandle() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bpclose\\s*\\(') THEN {'seq': 45, 'label': 'release_function_pclose', 'polarity': 'fp', 'w': 75, 'text': 'pclose() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '\\bregfree\\s*\\(') THEN {'seq': 46, 'label': 'release_function_regfree', 'polarity': 'fp', 'w': 75, 'text': 'regfree() is called'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '(?i)\\bstd::unique_ptr|\\bstd::shared_ptr|\\bauto_ptr|\\bQScopedPointer|\\bg_auto') THEN {'seq': 47, 'label': 'raii_smart_pointer', 'polarity': 'fp', 'w': 80, 'text': 'a smart pointer owns the resource'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND regexp_matches(code, '(?i)\\bgoto\\s+(cleanup|done|error|exit)') THEN {'seq': 48, 'label': 'goto_cleanup_pattern', 'polarity': 'fp', 'w': 65, 'text': 'all paths jump to one exit'} END",
    "CASE WHEN rule_set = 'RESOURCE_LEAK' AND (release_func = '') AND regexp_matches(code, '(?i)if\\s*\\(.*\\)\\s*\\{?\\s*return') AND NOT regexp_matches(code, '\\b(fclose|close|free|delete|CloseHandle|pclose|regfree)\\s*\\(') THEN {'seq': 49, 'label': 'early_return_without_release', 'polarity': 'bug', 'w': 70, 'text': 'an early return shows no release'} END",
    "CASE WHEN rule_set = 'DEADCODE' AND regexp_matches(code, '#if 0|#ifdef NEVER') THEN {'seq': 50, 'label': 'preprocessor_disabled_block', 'polarity': 'fp', 'w': 85, 'text': 'the preprocessor leaves the code out'} END",
    "CASE WHEN rule_set = 'DEADCODE' AND regexp_matches(code, '\\bTODO\\b|\\bFIXME\\b|\\bDEAD\\b|\\bXXX\\b') THEN {'seq': 51, 'label': 'marked_todo_fixme', 'polarity': 'fp', 'w': 60, 'text': 'the code is marked as unfinished'} END",
    "CASE WHEN rule_set = 'DEADCODE' AND regexp_matches(code, '\\bassert\\s*\\(\\s*0\\s*\\)|\\bassert\\s*\\(\\s*false\\s*\\)') THEN {'seq': 52, 'label': 'assert_unreachable', 'polarity': 'fp', 'w': 75, 'text': 'the path ends in an assertion'} END",
    "CASE WHEN rule_set = 'DEADCODE' AND (n_callers = 0 AND NOT caller_exempt) THEN {'seq': 53, 'label': 'function_has_no_callers', 'polarity': 'fp', 'w': 55, 'text': 'nobody calls the function'} END",
    "CASE WHEN rule_set = 'DEADCODE' AND (defect_confirmed) THEN {'seq': 54, 'label': 'trace_confirmed_unreachable', 'polarity': 'bug', 'w': 70, 'text': 'the trace shows the block cannot be reached'} END",
    "CASE WHEN rule_set = 'ARRAY_VS_SINGLETON' AND regexp_matches(code, '(?i)numocts\\s*==\\s*0|len\\s*==\\s*0|size\\s*==\\s*0|count\\s*==\\s*0') THEN {'seq': 55, 'label': 'zero_length_guard', 'polarity': 'fp', 'w': 80, 'text': 'a zero length is handled'} END",
    "CASE WHEN rule_set = 'ARRAY_VS_SINGLETON' AND regexp_matches(code, '(?i)\\bsizeof\\s*\\(\\s*\\*') THEN {'seq': 56, 'label': 'sizeof_deref_pattern', 'polarity': 'fp', 'w': 75, 'text': 'sizeof(*p) is the size of the target'} END",
    "CASE WHEN rule_set = 'NEGATIVE_RETURNS' AND (regexp_matches(code, '(?i)if\\s*\\(.*<\\s*0\\s*\\)') OR regexp_matches(code, '(?i)if\\s*\\(.*==\\s*EOF\\s*\\)')) THEN {'seq': 58, 'label': 'negative_return_checked', 'polarity': 'fp', 'w': 85, 'text': 'the result is compared before use'} END",
    "CASE WHEN rule_set = 'NEGATIVE_RETURNS' AND (trace_validates) THEN {'seq': 59, 'label': 'trace_shows_validation', 'polarity': 'fp', 'w': 80, 'text': 'the trace shows a validation'} END",
    "CASE WHEN rule_set = 'NEGATIVE_RETURNS' AND regexp_matches(code, '(?i)\\bmalloc\\s*\\(|\\bmemcpy\\s*\\(|\\[\\s*\\w+\\s*\\]') THEN {'seq': 60, 'label': 'negative_used_as_size', 'polarity': 'bug', 'w': 75, 'text': 'the result is used as size or index'} END",
    "CASE WHEN rule_set = 'UNUSED_VALUE' AND regexp_matches(code, '\\b(printf|log|debug|assert|cout|cerr|trace|LOG_|DBG_)\\b') THEN {'seq': 62, 'label': 'debug_logging_context', 'polarity': 'fp', 'w': 70, 'text': 'the value serves logging'} END",
    "CASE WHEN rule_set = 'UNUSED_VALUE' AND regexp_matches(code, '\\b(void)\\s*\\w+|\\(void\\)') THEN {'seq': 63, 'label': 'explicit_void_cast', 'polarity': 'fp', 'w': 75, 'text': 'the value is discarded explicitly'} END",
    "CASE WHEN rule_set = 'UNUSED_VALUE' AND regexp_matches(code, '(?i)\\breturn\\b') AND regexp_matches(code, '\\b(\\w+)\\s*=\\s*') THEN {'seq': 64, 'label': 'assigned_before_return', 'polarity': 'neutral', 'w': 0, 'text': 'the value is set before a return'} END",
    "CASE WHEN rule_set = 'UNINIT' AND (regexp_matches(code, '(?i)\\bmemset\\s*\\(|\\bcalloc\\s*\\(|\\b=\\s*\\{0\\}') OR regexp_matches(code, '(?i)struct\\s+\\w+\\s+\\w+\\s*=\\s*\\{0\\}')) THEN {'seq': 66, 'label': 'zero_initialization_present', 'polarity': 'fp', 'w': 85, 'text': 'the variable is zeroed first'} END",
    "CASE WHEN rule_set = 'UNINIT' AND regexp_matches(code, '(?i)\\b=\\s*\\{[^}]*\\}') THEN {'seq': 67, 'label': 'aggregate_initializer', 'polarity': 'fp', 'w': 80, 'text': 'an initializer list sets all fields'} END",
    "CASE WHEN rule_set = 'DIVIDE_BY_ZERO' AND regexp_matches(code, '(?i)if\\s*\\(.*!=\\s*0\\s*\\)|if\\s*\\(.*>\\s*0\\s*\\)|if\\s*\\(.*>=\\s*1\\s*\\)') THEN {'seq': 69, 'label': 'nonzero_guard_present', 'polarity': 'fp', 'w': 85, 'text': 'the divisor is checked'} END",
    "CASE WHEN rule_set = 'DIVIDE_BY_ZERO' AND (trace_validates) THEN {'seq': 70, 'label': 'trace_shows_nonzero_check', 'polarity': 'fp', 'w': 80, 'text': 'the trace shows a check of the divisor'} END",
    "CASE WHEN rule_set = 'USE_AFTER_FREE' AND regexp_matches(code, '(?i)\\bfree\\s*\\(.*\\)\\s*;') AND regexp_matches(code, '(?i)\\b\\w+\\s*=\\s*NULL\\s*;') AND regexp_matches(code, '(?i)\\bif\\s*\\(.*!=\\s*NULL') THEN {'seq': 72, 'label': 'null_after_free_with_check', 'polarity': 'fp', 'w': 80, 'text': 'the pointer is cleared and checked again'} END",
    "CASE WHEN rule_set = 'SIZEOF_MISMATCH' AND regexp_matches(code, '(?i)sizeof\\s*\\(\\s*\\*') THEN {'seq': 74, 'label': 'sizeof_deref_safe', 'polarity': 'fp', 'w': 80, 'text': 'sizeof(*p) is the size of the target'} END",
    "CASE WHEN rule_set = 'SIZEOF_MISMATCH' AND regexp_matches(code, '(?i)sizeof\\s*\\(\\s*\\w+\\s*\\[0\\]\\s*\\)') THEN {'seq': 75, 'label': 'sizeof_element_safe', 'polarity': 'fp', 'w': 75, 'text': 'sizeof(a[0]) is the size of an element'} END",
    "CASE WHEN rule_set = 'CONSTANT_EXPRESSION_RESULT' AND regexp_matches(code, '\\bassert\\s*\\(|\\bstatic_assert\\s*\\(') THEN {'seq': 77, 'label': 'assert_or_static_assert', 'polarity': 'fp', 'w': 80, 'text': 'the constant is asserted'} END",
    "CASE WHEN rule_set = 'CONSTANT_EXPRESSION_RESULT' AND regexp_matches(code, '#if') THEN {'seq': 78, 'label': 'preprocessor_conditional', 'polarity': 'fp', 'w': 65, 'text': 'the constant selects a configuration'} END",
    "CASE WHEN rule_set = 'SHIFT_OVERFLOW' AND regexp_matches(code, '(?i)if\\s*\\(.*<\\s*\\d+|if\\s*\\(.*>=\\s*\\d+') THEN {'seq': 80, 'label': 'shift_amount_validated', 'polarity': 'fp', 'w': 80, 'text': 'the shift amount is checked'} END",
    "CASE WHEN rule_set = 'NO_BREAK' AND regexp_matches(code, '(?i)//\\s*fallthrough|/\\*\\s*fall.?through|FALLTHRU|FALLTHROUGH|\\[\\[fallthrough\\]\\]') THEN {'seq': 82, 'label': 'documented_fallthrough', 'polarity': 'fp', 'w': 90, 'text': 'the fall-through is marked as wanted'} END",
]
LATER = [
    "CASE WHEN rule_set = 'ARRAY_VS_SINGLETON' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 57, 'label': 'singleton_passed_as_array', 'polarity': 'bug', 'w': 65, 'text': 'one element is passed where many are expected'} END",
    "CASE WHEN rule_set = 'NEGATIVE_RETURNS' AND len(list_filter(ev1, lambda e: e.polarity <> 'neutral')) = 0 THEN {'seq': 61, 'label': 'no_visible_validation', 'polarity': 'bug', 'w': 55, 'text': 'no validation is visible'} END",
    "CASE WHEN rule_set = 'UNUSED_VALUE' AND len(list_filter(ev1, lambda e: e.polarity <> 'neutral')) = 0 THEN {'seq': 65, 'label': 'value_computed_not_used', 'polarity': 'bug', 'w': 60, 'text': 'the value is never read'} END",
    "CASE WHEN rule_set = 'UNINIT' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 68, 'label': 'read_before_assignment', 'polarity': 'bug', 'w': 75, 'text': 'the variable is read before it is set'} END",
    "CASE WHEN rule_set = 'DIVIDE_BY_ZERO' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 71, 'label': 'division_without_guard', 'polarity': 'bug', 'w': 75, 'text': 'no check of the divisor is visible'} END",
    "CASE WHEN rule_set = 'USE_AFTER_FREE' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 73, 'label': 'possible_use_after_free', 'polarity': 'bug', 'w': 70, 'text': 'the pointer may be used after free()'} END",
    "CASE WHEN rule_set = 'SIZEOF_MISMATCH' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 76, 'label': 'sizeof_wrong_type', 'polarity': 'bug', 'w': 70, 'text': 'sizeof may measure the wrong type'} END",
    "CASE WHEN rule_set = 'CONSTANT_EXPRESSION_RESULT' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 79, 'label': 'suspicious_constant_expression', 'polarity': 'bug', 'w': 55, 'text': 'the result never changes'} END",
    "CASE WHEN rule_set = 'SHIFT_OVERFLOW' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 81, 'label': 'shift_without_guard', 'polarity': 'bug', 'w': 70, 'text': 'the shift amount is not checked'} END",
    "CASE WHEN rule_set = 'NO_BREAK' AND len(list_filter(ev1, lambda e: e.polarity = 'fp')) = 0 THEN {'seq': 83, 'label': 'missing_break_statement', 'polarity': 'bug', 'w': 65, 'text': 'a case runs into the next'} END",
]
