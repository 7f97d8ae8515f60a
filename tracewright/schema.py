"""Dimensions: fixed values that operators use unless a caller passes tables of their own."""

from __future__ import annotations

# x86-64 numbers of the system calls that operators handle. A full table is a parameter
# (``enrich.syscall_names(spark, path)`` reads the kernel's header); other numbers are "unknown".
SYSCALLS = {
    0: "read", 1: "write", 2: "open", 17: "pread64", 18: "pwrite64", 19: "readv", 20: "writev", 22: "pipe", 29: "shmget", 30: "shmat",
    32: "dup", 33: "dup2", 40: "sendfile", 41: "socket", 42: "connect", 43: "accept", 44: "sendto", 45: "recvfrom", 46: "sendmsg", 47: "recvmsg",
    49: "bind", 56: "clone", 57: "fork", 58: "vfork", 59: "execve", 62: "kill", 67: "shmdt", 68: "msgget", 69: "msgsnd", 70: "msgrcv", 71: "msgctl",
    82: "rename", 83: "mkdir", 85: "creat", 87: "unlink", 90: "chmod", 91: "fchmod", 92: "chown", 93: "fchown", 101: "ptrace", 105: "setuid", 106: "setgid",
    113: "setreuid", 114: "setregid", 117: "setresuid", 119: "setresgid", 159: "adjtimex", 164: "settimeofday", 175: "init_module", 227: "clock_settime",
    231: "exit_group", 234: "tgkill", 240: "mq_open", 242: "mq_timedsend", 243: "mq_timedreceive", 257: "openat", 258: "mkdirat", 260: "fchownat",
    263: "unlinkat", 264: "renameat", 268: "fchmodat", 275: "splice", 276: "tee", 288: "accept4", 292: "dup3", 293: "pipe2", 295: "preadv", 296: "pwritev",
    299: "recvmmsg", 307: "sendmmsg", 313: "finit_module", 316: "renameat2", 319: "memfd_create", 322: "execveat", 326: "copy_file_range", 327: "preadv2",
    328: "pwritev2", 435: "clone3", 437: "openat2",
}

# What a call does, as (class, op).
OPS = {
    ("process", "Fork"): "clone clone3 fork vfork memfd_create",
    ("process", "Exec"): "execve execveat",
    ("process", "Exit"): "exit_group",
    ("process", "Signal"): "kill tgkill ptrace msgget msgsnd msgrcv mq_open mq_timedsend mq_timedreceive",
    ("file", "Open"): "open openat openat2 creat",
    ("file", "Read"): "read pread64 readv preadv preadv2",
    ("file", "Write"): "write pwrite64 writev pwritev pwritev2",
    ("file", "Unlink"): "unlink unlinkat",
    ("file", "Rename"): "rename renameat renameat2",
    ("file", "Chmod"): "chmod fchmod fchmodat",
    ("file", "Chown"): "chown fchown fchownat",
    ("net", "Socket"): "socket",
    ("net", "Connect"): "connect",
    ("net", "Bind"): "bind",
    ("net", "Accept"): "accept accept4",
    ("net", "SendTo"): "sendto sendmsg sendmmsg",
    ("net", "RecvFrom"): "recvfrom recvmsg recvmmsg",
    ("transfer", "Read"): "sendfile splice tee copy_file_range",
}

# Calls that the audit policy records.
AUDITED = (
    "openat open openat2 creat execve execveat rename renameat renameat2 unlink unlinkat chmod fchmodat chown fchownat connect bind "
    "sendto sendmsg recvmsg sendmmsg recvmmsg msgget msgsnd msgrcv mq_open mq_timedsend mq_timedreceive sendfile splice tee copy_file_range"
).split()

# How much of a score passes along an edge of each type.
DECAY = {"fork": 0.9, "pipe": 0.7, "file": 0.5, "mqueue": 0.7}

# Open flags that mean writing (O_WRONLY | O_RDWR | O_CREAT | O_TRUNC), and a score that counts as tainted.
WRITE_FLAGS = 1 | 2 | 64 | 512
TAINTED = 0.1

# Paths that count as sensitive: prefixes and one glob of the baseline; parts for receipts; parts for graphs.
BASELINE_SENSITIVE = ["/etc/shadow", "/etc/passwd", "/etc/sudoers", "/root/.ssh", "/home/*/.ssh", "/etc/ssl/private", "/etc/crontab", "/var/spool/cron"]
RECEIPT_SENSITIVE = ["/etc/shadow", "/etc/passwd", "/.ssh/", "/etc/sudoers", "api_token", "secret", "credential", ".env", "private_key", "/etc/firewall"]
GRAPH_SENSITIVE = ["/etc/shadow", "/etc/passwd", "/.ssh/", "/etc/sudoers"]

# Netlink protocols by number.
NETLINK = {
    0: "route", 2: "usersock", 3: "firewall", 4: "sock_diag", 5: "nflog", 6: "xfrm", 7: "selinux", 8: "iscsi", 9: "audit", 10: "fib_lookup", 11: "connector",
    12: "netfilter", 13: "ip6_fw", 15: "kobject_uevent", 16: "generic", 18: "scsi", 19: "ecryptfs", 20: "rdma", 21: "crypto", 22: "smc",
}

# Detection rules as (name, calls, file patterns, processes, excluded processes, technique, severity).
RULES = [
    ("Cron job modification", "openat open rename renameat", "/etc/cron* /var/spool/cron* */crontab", "", "cron crond anacron", "T1053.003", 3),
    ("Shell config modification", "openat open", "*/.bashrc */.bash_profile */.profile */.zshrc */.cshrc /etc/profile* /etc/bash.bashrc /etc/zsh*", "", "", "T1546.004", 2),
    ("Systemd service modification", "openat open", "/etc/systemd/* /lib/systemd/* /usr/lib/systemd/*", "", "systemd systemctl", "T1543", 3),
    ("SSH authorized_keys modification", "openat open", "*/.ssh/authorized_keys*", "", "sshd", "T1098.004", 3),
    ("Setuid/setgid call", "setuid setgid setreuid setregid setresuid setresgid", "", "", "sudo su login sshd passwd chsh newgrp", "T1548.001", 2),
    ("Kernel module load", "init_module finit_module", "", "", "", "T1547.006", 3),
    ("Container escape attempt", "execve execveat", "", "nsenter unshare", "", "T1611", 3),
    ("Timestomping", "settimeofday clock_settime adjtimex", "", "", "chronyd ntpd systemd-timesyncd", "T1070.006", 2),
    ("File deletion (evidence removal)", "unlink unlinkat rename renameat renameat2", "/var/log* */.bash_history */auth.log* */syslog*", "", "logrotate", "T1070", 3),
    ("Hidden file/directory creation", "openat open mkdir mkdirat", "/tmp/.* /var/tmp/.* /dev/shm/.*", "", "", "T1564.001", 2),
    ("Chmod sensitive file", "chmod fchmod fchmodat", "/etc/* /usr/bin/* /usr/sbin/*", "", "dpkg rpm apk apt", "T1222.002", 2),
    ("Credential file read", "openat open", "/etc/shadow /etc/gshadow /etc/master.passwd */.ssh/id_* */.ssh/known_hosts */.aws/credentials */.docker/config.json */.kube/config */.netrc */.pgpass", "", "sshd login passwd shadow chage", "T1552.001", 3),
    ("Password store access", "openat open", "*/passwords.xml */.mozilla/*/logins.json */.config/chromium/*/Login* */key3.db */key4.db", "", "", "T1555", 3),
    ("Passwd/shadow modification", "openat open", "/etc/passwd /etc/shadow /etc/group", "", "passwd useradd usermod groupadd groupmod adduser addgroup", "T1098", 3),
    ("Network discovery", "execve execveat", "", "ifconfig ip netstat ss arp route nmap masscan ping traceroute", "", "T1046", 1),
    ("Archive creation (staging data)", "execve execveat", "", "tar gzip zip bzip2 xz 7z rar", "", "T1560", 1),
    ("Outbound network connection", "connect", "", "", "apt apt-get apk yum dnf pip npm git", "T1071", 1),
    ("Curl/wget download", "execve execveat", "", "curl wget", "", "T1105", 2),
    ("Netcat/socat (reverse shell tool)", "execve execveat", "", "nc ncat netcat socat", "", "T1059.004", 3),
    ("Data exfiltration tool", "execve execveat", "", "scp sftp rsync", "", "T1048", 2),
    ("Cryptominer detection", "execve execveat", "", "xmrig minerd minergate cpuminer ethminer", "", "T1496", 3),
    ("Data destruction (bulk delete)", "execve execveat", "", "rm shred wipe", "", "T1485", 2),
    ("Ptrace process injection", "ptrace", "", "", "gdb strace ltrace lldb", "T1055.008", 3),
    ("Debug tool execution", "execve execveat", "", "gdb strace ltrace lldb", "", "T1055", 2),
    ("Source compilation", "execve execveat", "", "gcc g++ cc c++ clang clang++ rustc javac go", "", "T1027.004", 1),
    ("Memfd create (fileless execution vector)", "memfd_create", "", "", "", "T1620", 3),
    ("Kernel-space data transfer (sendfile/splice)", "sendfile splice tee copy_file_range", "", "", "nginx apache2 httpd haproxy", "T1048", 2),
    ("SSH client execution", "execve execveat", "", "ssh sshpass", "", "T1021.004", 2),
]

# Fixed values: (fill, border) of action 0, then of actions 1 to 20 and on in turn.
BASELINE_COLOUR = ("#e8e8e8", "#999999")
ACTION_COLOURS = [
    ("#bbdefb", "#1565c0"), ("#c8e6c9", "#2e7d32"), ("#fff9c4", "#f9a825"), ("#ffccbc", "#d84315"), ("#e1bee7", "#7b1fa2"),
    ("#b2ebf2", "#00838f"), ("#f8bbd0", "#c2185b"), ("#d7ccc8", "#5d4037"), ("#c5cae9", "#283593"), ("#dcedc8", "#558b2f"),
    ("#ffe0b2", "#e65100"), ("#b3e5fc", "#0277bd"), ("#f0f4c3", "#9e9d24"), ("#ffcdd2", "#b71c1c"), ("#d1c4e9", "#4527a0"),
    ("#b2dfdb", "#00695c"), ("#ffe082", "#ff8f00"), ("#f3e5f5", "#6a1b9a"), ("#e0f7fa", "#006064"), ("#fce4ec", "#880e4f"),
]
