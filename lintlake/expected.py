"""Expected results of the corpus templates, derived by hand-checkable brute force (tests/brute.py).

Fixed values used by the SQL checks; {k} stands for the key of the row.
"""

# Per template: language, parse result, line counts, structure counts, all nodes and tree height.
FILES = """(VALUES
    (0, 'python', TRUE, 2, 2, 0, 0, 1, 0, 0, 0, 0, 0, 1, 2, 2, 12, 5),
    (1, 'python', TRUE, 6, 5, 0, 1, 1, 0, 1, 0, 1, 1, 2, 6, 6, 25, 6),
    (2, 'python', TRUE, 6, 6, 0, 0, 1, 0, 2, 0, 1, 2, 3, 6, 6, 39, 8),
    (3, 'python', TRUE, 6, 6, 0, 0, 1, 0, 2, 1, 0, 3, 4, 6, 6, 25, 7),
    (4, 'python', TRUE, 7, 7, 0, 0, 1, 0, 3, 0, 1, 3, 4, 7, 7, 40, 7),
    (5, 'python', TRUE, 6, 6, 0, 0, 1, 0, 1, 0, 1, 1, 2, 6, 6, 27, 5),
    (6, 'python', TRUE, 11, 11, 0, 0, 1, 0, 1, 2, 5, 3, 4, 11, 11, 87, 8),
    (7, 'python', TRUE, 4, 4, 0, 0, 1, 0, 0, 1, 0, 1, 2, 4, 4, 32, 7),
    (8, 'python', TRUE, 7, 7, 0, 0, 1, 0, 0, 1, 3, 1, 2, 7, 7, 63, 7),
    (9, 'python', TRUE, 2, 2, 0, 0, 1, 0, 0, 0, 0, 0, 1, 2, 2, 24, 8),
    (10, 'python', TRUE, 8, 6, 2, 0, 1, 0, 0, 0, 2, 0, 1, 5, 5, 32, 6),
    (11, 'python', FALSE, 2, 2, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (12, 'python', TRUE, 17, 13, 4, 0, 3, 1, 0, 1, 1, 1, 4, 9, 4, 58, 8),
    (13, 'python', TRUE, 17, 17, 0, 0, 1, 0, 1, 4, 4, 4, 11, 17, 17, 83, 9),
    (14, 'python', TRUE, 11, 11, 0, 0, 2, 0, 3, 0, 1, 3, 4, 14, 11, 41, 6),
    (15, 'python', TRUE, 2, 0, 2, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0),
    (16, 'c', TRUE, 14, 11, 1, 2, 1, 0, 2, 4, 2, 1, 7, 11, 11, 10, 2),
    (17, 'java', TRUE, 11, 10, 0, 1, 1, 0, 2, 0, 6, 1, 3, 8, 8, 10, 2),
    (18, 'javascript', TRUE, 10, 10, 0, 0, 2, 0, 4, 2, 5, 1, 7, 10, 6, 14, 2),
    (19, 'python', TRUE, 5, 5, 0, 0, 1, 0, 0, 0, 1, 0, 1, 5, 5, 32, 6)
  ) AS files(k, lang, ok, total_lines, code_lines, blank_lines, comment_lines, n_functions, n_classes, n_loops, n_conditions, n_variables, nesting, cc, sum_length, max_length, n_nodes, height)"""

# Functions in walk order.
FUNCTIONS = """(VALUES
    (0, 0, 'add_{k}', 1, 2, 2, FALSE, '', NULL, 1),
    (1, 0, 'total_{k}', 1, 6, 1, FALSE, '', NULL, 2),
    (2, 0, 'pairs_{k}', 1, 6, 1, FALSE, '', NULL, 3),
    (3, 0, 'find_{k}', 1, 6, 2, FALSE, '', NULL, 4),
    (4, 0, 'cube_{k}', 1, 7, 1, FALSE, '', NULL, 4),
    (5, 0, 'halve_{k}', 1, 6, 1, FALSE, '', NULL, 2),
    (6, 0, 'search_{k}', 1, 11, 2, FALSE, '', NULL, 4),
    (7, 0, 'fib_{k}', 1, 4, 1, FALSE, '', NULL, 2),
    (8, 0, 'msort_{k}', 1, 7, 1, FALSE, '', NULL, 2),
    (9, 0, 'fact_{k}', 1, 2, 1, FALSE, '', NULL, 1),
    (10, 0, 'run_{k}', 4, 8, 1, FALSE, '', NULL, 1),
    (12, 0, 'get', 6, 8, 1, TRUE, '', 'Return it.', 1),
    (12, 1, 'make', 11, 12, 2, TRUE, 'staticmethod', NULL, 1),
    (12, 2, 'get', 14, 17, 2, TRUE, '', NULL, 4),
    (13, 0, 'grade_{k}', 1, 17, 1, FALSE, '', NULL, 11),
    (14, 0, 'outer_{k}', 1, 11, 1, FALSE, '', NULL, 4),
    (14, 1, 'inner', 8, 10, 1, FALSE, '', NULL, 1),
    (16, 0, 'copy_{k}', 4, 14, 0, FALSE, '', NULL, 4),
    (17, 0, 'run{k}', 3, 10, 0, FALSE, '', NULL, 2),
    (18, 0, 'show_{k}', 1, 6, 0, FALSE, '', NULL, 3),
    (18, 1, 'go_{k}', 7, 10, 0, FALSE, '', NULL, 2),
    (19, 0, 'load_{k}', 1, 5, 1, FALSE, '', NULL, 1)
  ) AS functions(k, i, name, start_line, end_line, params, is_method, decorators, docstring, cc)"""

# Loops.
LOOPS = """(VALUES
    (1, 'for', 4, 5, 1, 'total_{k}', 'x'),
    (2, 'for', 3, 5, 1, 'pairs_{k}', 'i'),
    (2, 'for', 4, 5, 2, 'pairs_{k}', 'j'),
    (3, 'for', 2, 5, 1, 'find_{k}', 'row'),
    (3, 'for', 3, 5, 2, 'find_{k}', 'cell'),
    (4, 'for', 3, 6, 1, 'cube_{k}', 'i'),
    (4, 'for', 4, 6, 2, 'cube_{k}', 'j'),
    (4, 'for', 5, 6, 3, 'cube_{k}', 'l'),
    (5, 'while', 3, 5, 1, 'halve_{k}', ''),
    (6, 'while', 3, 10, 1, 'search_{k}', ''),
    (13, 'while', 12, 14, 1, 'grade_{k}', ''),
    (14, 'for', 2, 7, 1, 'outer_{k}', 'x'),
    (14, 'for', 5, 7, 2, 'outer_{k}', 'y'),
    (14, 'for', 6, 7, 3, 'outer_{k}', 'z'),
    (16, 'for', 11, 11, 1, 'copy_{k}', ''),
    (16, 'for', 12, 12, 1, NULL, ''),
    (17, 'while', 5, 5, 1, 'run{k}', ''),
    (17, 'while', 5, 5, 1, NULL, ''),
    (18, 'do', 3, 3, 1, 'show_{k}', ''),
    (18, 'while', 5, 5, 1, 'show_{k}', ''),
    (18, 'do', 3, 3, 1, NULL, ''),
    (18, 'while', 5, 5, 1, NULL, '')
  ) AS loops(k, keyword, start_line, end_line, depth, fn, target)"""

# Conditions.
CONDITIONS = """(VALUES
    (3, 'if', 4, 5, FALSE, 1, 'find_{k}'),
    (6, 'if', 5, 10, TRUE, 3, 'search_{k}'),
    (6, 'if', 7, 10, TRUE, 2, 'search_{k}'),
    (7, 'if', 2, 3, FALSE, 1, 'fib_{k}'),
    (8, 'if', 2, 3, FALSE, 1, 'msort_{k}'),
    (12, 'if', 15, 16, FALSE, 1, 'get'),
    (13, 'if', 2, 9, TRUE, 4, 'grade_{k}'),
    (13, 'if', 4, 9, TRUE, 3, 'grade_{k}'),
    (13, 'if', 6, 9, TRUE, 2, 'grade_{k}'),
    (13, 'if', 13, 14, FALSE, 1, 'grade_{k}'),
    (16, 'if', 6, 6, FALSE, 1, 'copy_{k}'),
    (16, 'else', 8, 8, FALSE, 1, 'copy_{k}'),
    (16, 'if', 7, 7, FALSE, 1, NULL),
    (16, 'else', 9, 9, FALSE, 1, NULL),
    (18, 'switch', 9, 9, FALSE, 1, 'go_{k}'),
    (18, 'switch', 9, 9, FALSE, 1, 'go_{k}')
  ) AS conditions(k, keyword, start_line, end_line, has_else, branches, fn)"""

# Variables.
VARIABLES = """(VALUES
    (1, 's', 3, 'local', NULL, 'total_{k}'),
    (2, 'out', 2, 'local', NULL, 'pairs_{k}'),
    (4, 'c', 2, 'local', NULL, 'cube_{k}'),
    (5, 'steps', 2, 'local', NULL, 'halve_{k}'),
    (6, 'lo', 2, 'local', NULL, 'search_{k}'),
    (6, 'hi', 2, 'local', NULL, 'search_{k}'),
    (6, 'mid', 4, 'local', NULL, 'search_{k}'),
    (6, 'lo', 8, 'local', NULL, 'search_{k}'),
    (6, 'hi', 10, 'local', NULL, 'search_{k}'),
    (8, 'half', 4, 'local', NULL, 'msort_{k}'),
    (8, 'left', 5, 'local', NULL, 'msort_{k}'),
    (8, 'right', 6, 'local', NULL, 'msort_{k}'),
    (10, 'password', 5, 'local', NULL, 'run_{k}'),
    (10, 'y', 7, 'local', NULL, 'run_{k}'),
    (12, 'limit', 4, 'global', 'int', NULL),
    (13, 'g', 3, 'local', NULL, 'grade_{k}'),
    (13, 'g', 5, 'local', NULL, 'grade_{k}'),
    (13, 'g', 7, 'local', NULL, 'grade_{k}'),
    (13, 'g', 9, 'local', NULL, 'grade_{k}'),
    (14, 'mid', 9, 'local', NULL, 'inner'),
    (16, 'n', 5, 'local', NULL, 'copy_{k}'),
    (16, 'n', 6, 'global', NULL, NULL),
    (17, 'x', 4, 'local', NULL, 'run{k}'),
    (17, 's', 8, 'local', NULL, 'run{k}'),
    (17, 'x', 9, 'local', NULL, 'run{k}'),
    (17, 'x', 4, 'local', NULL, 'run{k}'),
    (17, 's', 8, 'local', NULL, 'run{k}'),
    (17, 'x', 9, 'local', NULL, 'run{k}'),
    (18, 'v', 2, 'local', NULL, 'show_{k}'),
    (18, 't', 8, 'local', NULL, 'go_{k}'),
    (18, 'v', 2, 'local', NULL, 'show_{k}'),
    (18, 'go_{k}', 7, 'global', NULL, NULL),
    (18, 't', 8, 'local', NULL, 'go_{k}'),
    (19, 'rows', 3, 'local', NULL, 'load_{k}')
  ) AS variables(k, name, line, scope, annotation, fn)"""

# Complexity estimates.
ESTIMATES = """(VALUES
    (0, 0, 'add_{k}', 'O(1)', 0.95, 'constant_operation', FALSE, 1, 2, 0, 0, FALSE),
    (1, 0, 'total_{k}', 'O(n)', 0.9, 'single_loop', FALSE, 1, 6, 1, 0, FALSE),
    (2, 0, 'pairs_{k}', 'O(n²)', 0.9, 'nested_loop_2', FALSE, 1, 6, 2, 0, FALSE),
    (3, 0, 'find_{k}', 'O(n²)', 0.63, 'nested_loop_2', FALSE, 1, 6, 2, 0, FALSE),
    (4, 0, 'cube_{k}', 'O(n³)', 0.9, 'nested_loop_3', FALSE, 1, 7, 3, 0, FALSE),
    (5, 0, 'halve_{k}', 'O(log n)', 0.85, 'logarithmic_loop', FALSE, 1, 6, 1, 0, FALSE),
    (6, 0, 'search_{k}', 'O(log n)', 0.9, 'binary_search', FALSE, 1, 11, 1, 0, FALSE),
    (7, 0, 'fib_{k}', 'O(2^n)', 0.85, 'exponential_recursion', TRUE, 1, 4, 0, 2, TRUE),
    (8, 0, 'msort_{k}', 'O(n log n)', 0.75, 'divide_and_conquer', TRUE, 1, 7, 0, 2, TRUE),
    (9, 0, 'fact_{k}', 'O(n)', 0.8, 'linear_recursion', TRUE, 1, 2, 0, 1, TRUE),
    (10, 0, 'run_{k}', 'O(n log n)', 0.9, 'efficient_sort', FALSE, 4, 8, 0, 0, FALSE),
    (12, 0, 'get', 'O(1)', 0.95, 'constant_operation', FALSE, 6, 8, 0, 0, FALSE),
    (12, 1, 'make', 'O(1)', 0.95, 'constant_operation', FALSE, 11, 12, 0, 0, FALSE),
    (12, 2, 'get', 'O(1)', 0.95, 'constant_operation', FALSE, 14, 17, 0, 0, FALSE),
    (13, 0, 'grade_{k}', 'O(n)', 0.9, 'single_loop', FALSE, 1, 17, 1, 0, FALSE),
    (14, 0, 'outer_{k}', 'O(log n)', 0.9, 'binary_search', FALSE, 1, 11, 1, 0, FALSE),
    (14, 1, 'inner', 'O(log n)', 0.9, 'binary_search', TRUE, 8, 10, 0, 1, TRUE),
    (19, 0, 'load_{k}', 'O(n log n)', 0.9, 'efficient_sort', FALSE, 1, 5, 0, 0, FALSE)
  ) AS estimates(k, i, name, cls, sure, pattern, recursive, start_line, end_line, depth, branches, called)"""

# Loop chains of each function.
NESTS = """(VALUES
    (1, 0, 'total_{k}', 1, 'for', 4, 5, FALSE, FALSE),
    (2, 0, 'pairs_{k}', 2, 'for,for', 3, 5, FALSE, FALSE),
    (3, 0, 'find_{k}', 2, 'for,for', 2, 5, TRUE, FALSE),
    (4, 0, 'cube_{k}', 3, 'for,for,for', 3, 6, FALSE, FALSE),
    (5, 0, 'halve_{k}', 1, 'while', 3, 5, FALSE, FALSE),
    (6, 0, 'search_{k}', 1, 'while', 3, 10, FALSE, TRUE),
    (13, 0, 'grade_{k}', 1, 'while', 12, 14, FALSE, TRUE),
    (14, 0, 'outer_{k}', 1, 'for', 2, 7, FALSE, FALSE)
  ) AS nests(k, i, name, depth, types, start_line, end_line, has_break, has_return)"""

# Security findings in report order, for m = 3.
FINDINGS = """(VALUES
    (10, 0, 'SEC-007', 'HIGH', 5, 4, 'password = "p{m}"'),
    (10, 1, 'SEC-002', 'HIGH', 6, 4, 'os.system(x)'),
    (10, 2, 'SEC-016', 'HIGH', 7, 8, 'y = eval(x)'),
    (13, 0, 'SEC-014', 'LOW', 15, 4, 'except Exception:'),
    (16, 0, 'SEC-004', 'HIGH', 8, 8, 'strcpy(d, s); // unsafe'),
    (16, 1, 'SEC-015', 'LOW', 12, 30, 'for (n = 0; n < 3; n++) { gets(d); }'),
    (17, 0, 'SEC-001', 'HIGH', 8, 20, 'String s = "SELECT a FROM t WHERE b=" + q;'),
    (18, 0, 'SEC-008', 'MEDIUM', 2, 12, 'const v = Math.random();'),
    (18, 1, 'SEC-010', 'HIGH', 4, 7, 'el.innerHTML = v;'),
    (19, 0, 'SEC-003', 'HIGH', 5, 26, 'return pick(rows[{m}], ''../etc'')')
  ) AS findings(k, i, rule_id, severity, line, col, snippet)"""
